"""Files as numbered lines ``file, line, byte, text``.

A line ends at ``\\n`` only; one trailing ``\\r`` is no part of it; the last line needs no end; an empty file has no lines.
Files are read in parallel by splits. Lines are numbered within their split as they stream by, and a split's base is a
prefix sum over one row a split: no text is shuffled, nothing is sorted, and no split is read by the driver. That goes for
all encodings: in all of them but UTF-16 the byte 0x0A is a line end and nothing else, so splits are decoded as they are;
UTF-16 has a reader of its own over aligned ranges. Malformed bytes become U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import without_cr
from ..runtime import lookup_join
from .files import Utf16Source, opened

#: encoding keys -> names the JVM knows
ENCODINGS = {
    "utf8": "UTF-8", "windows1252": "windows-1252", "utf16le": "UTF-16LE", "utf16be": "UTF-16BE", "shiftjis": "Shift_JIS", "eucjp": "EUC-JP", "euckr": "EUC-KR",
    "gb18030": "GB18030", "big5": "Big5", "windows1250": "windows-1250", "windows1251": "windows-1251", "koi8r": "KOI8-R", "iso88592": "ISO-8859-2",
}
#: encoding keys -> Python's names, where they differ
CODECS = {"windows1252": "cp1252", "shiftjis": "cp932", "eucjp": "euc_jp", "euckr": "cp949", "windows1250": "cp1250", "windows1251": "cp1251", "koi8r": "koi8_r", "iso88592": "iso8859_2", "utf16le": "utf-16-le", "utf16be": "utf-16-be"}
BOMS = [(b"\xef\xbb\xbf", "utf8"), (b"\xff\xfe", "utf16le"), (b"\xfe\xff", "utf16be")]


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """Lines of plain (or gz, bz2) text files in one of ENCODINGS, UTF-8 unless given."""
    paths = paths if isinstance(paths, list) else [paths]
    if encoding in ("utf16le", "utf16be"):
        spark.dataSource.register(Utf16Source)
        ranges = spark.read.format("tidemark_utf16").option("paths", "\n".join(paths)).option("encoding", encoding).load()
        sizes = ranges.groupBy("file", "split").agg(F.count("*").alias("n"))
        own = ranges.select("file", "split", "k", F.col("byte").alias("b"), "text")
        base = sizes.select("file", "split", _earlier("n").alias("line0"), F.lit(0).alias("byte0"))
    else:
        raw = spark.read.option("lineSep", "\n").text(paths)
        rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
        sizes = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
        own = rows.mapInArrow(_numbered(CODECS.get(encoding, encoding or "utf8")), "file string, split long, k long, b long, text string")
        base = sizes.select("file", "split", _earlier("n").alias("line0"), _earlier("bytes").alias("byte0"))
    out = lookup_join(own, base, ["file", "split"], "inner", salt_by=F.col("k"))
    line = F.col("line0") + F.col("k")
    return out.select("file", line.cast("long").alias("line"), (F.col("byte0") + F.col("b")).cast("long").alias("byte"), F.when(line == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")).alias("text"))


def _earlier(c: str) -> Column:
    """Sum over the earlier splits of a file; one row per split."""
    return F.coalesce(F.sum(c).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbered(codec: str):
    """``file, split, value`` as they are read -> the same with a line's number and first byte within its split, and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, byte = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, split, value = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            names = file.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((split[1:] != split[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), batch.num_rows]
            sizes = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            k, b = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for x, y in zip(edges, edges[1:]):
                now = (file[x].as_py(), int(split[x]))
                if now != at:
                    at, line, byte = now, 0, 0
                ends = byte + np.cumsum(sizes[x:y])
                k[x:y] = np.arange(line + 1, line + 1 + y - x)
                b[x:y] = ends - sizes[x:y]
                line, byte = line + y - x, int(ends[-1])
            yield pa.RecordBatch.from_arrays([file, pa.array(split), pa.array(k), pa.array(b), _decoded(value, codec)], ["file", "split", "k", "b", "text"])

    return run


def _decoded(value: pa.Array, codec: str) -> pa.Array:
    """Lines as text, without a carriage return at their end."""
    if codec == "utf8":
        try:
            text = value.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([v.decode("utf8", "replace") for v in value.to_pylist()], pa.string())
    else:
        text = pa.array([v.decode(codec, "replace") for v in value.to_pylist()], pa.string())
    return pc.replace_substring_regex(text, r"\r$", "")


def split_text(decoded: Column) -> Column:
    """Lines of a decoded text: no empty line after a final line end."""
    parts = F.split(decoded, "\n", -1)
    return F.when(decoded == "", F.array().cast("array<string>")).when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def from_column(df: DataFrame, file: str, text: str) -> DataFrame:
    """Lines of texts in a column, one text per file name."""
    parts = df.where(F.col(text).isNotNull()).select(F.col(file).cast("string").alias("file"), split_text(F.col(text)).alias("p"))
    numbered = parts.select("file", F.posexplode("p").alias("i", "t"))
    return numbered.select("file", (F.col("i") + 1).cast("long").alias("line"), without_cr(F.col("t")).alias("text"))


def from_text(spark: SparkSession, text: str, name: str = "pasted") -> DataFrame:
    return from_column(spark.createDataFrame([(name, text)], "file string, text string"), "file", "text")


def with_bytes(lines: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Lines with ``byte``, each line's start, as if all ended in one ``\\n``; sums within blocks of lines plus the sizes
    of earlier blocks. All columns are shuffled: give ``size`` (bytes with the line end) instead of ``text`` where the text is not needed."""
    size = F.col("size") if "size" in lines.columns else F.octet_length(F.coalesce("text", F.lit(""))) + 1
    b = lines.withColumn("__b", F.floor(F.col("line") / block).cast("long"))
    per = b.groupBy("file", "__b").agg(F.sum(size).alias("__n"))
    before = per.withColumn("__o", F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    here = F.coalesce(F.sum(size).over(Window.partitionBy("file", "__b").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("byte", here).join(before, ["file", "__b"]).withColumn("byte", (F.col("byte") + F.col("__o")).cast("long")).drop("__b", "__o")


def line_at_byte(lines: DataFrame, byte: int) -> DataFrame:
    """The line of each file that holds a byte."""
    return lines.where(F.col("byte") <= byte).groupBy("file").agg(F.max("line").alias("line"))


def byte_range(lines: DataFrame, line: int) -> DataFrame:
    """``file, start, end`` of one line, its line end left out."""
    return lines.where(F.col("line") == line).select("file", F.col("byte").alias("start"), (F.col("byte") + F.octet_length("text")).alias("end"))


def head(lines: DataFrame, most: int) -> DataFrame:
    """Lines cut to ``most`` bytes, with ``total_bytes`` and ``truncated``."""
    n = F.octet_length("text")
    cut = F.make_valid_utf8(F.substr(F.col("text").cast("binary"), F.lit(1), F.lit(most)).cast("string"))
    return lines.select("file", "line", F.when(n > most, F.regexp_replace(cut, "\ufffd$", "")).otherwise(F.col("text")).alias("text"), n.alias("total_bytes"), (n > most).alias("truncated"))


def line_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count("*").alias("lines"))


def detect_encoding(data: bytes) -> str:
    """Encoding key of a file's head: byte order mark, else UTF-8 if valid (a character cut at the end is allowed), else the
    likeliest of the other encodings by the characters it gives, Windows-1252 if none speaks for itself."""
    for mark, key in BOMS:
        if data.startswith(mark):
            return key
    if looks_utf16(data):
        return "utf16le" if data[1::2].count(0) >= data[0::2].count(0) else "utf16be"
    try:
        data.decode("utf-8")
        return "utf8"
    except UnicodeDecodeError as e:
        if e.start >= len(data) - 3 and e.reason == "unexpected end of data":
            return "utf8"
    scores = {key: _likely(data, key) for key in ("shiftjis", "eucjp", "euckr", "gb18030", "big5", "windows1251", "koi8r", "windows1250", "iso88592", "windows1252")}
    return max(scores, key=lambda k: (scores[k], k == "windows1252"))


# Frequent characters of Chinese text in either script, and letters of Central and Western Europe.
_SIMPLIFIED = set("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运错误库文件连接失败")
_TRADITIONAL = set("的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日軍者意無力它與長把機十民第公此已工使情明性知全三又關點正業外將兩高間由問很最重並物手應戰向頭文體政美相見被利什二等產或新己制身果加西斯月話合回特代內信表化老給世位次度門任常先海通教兒原東聲提立及比員解水名真論處走義各入幾口認條平系氣題活爾更別打女變四神總何電數安少報才結反受目太量再感建務做接必場件計管期市直德資命山金指克許統區保至隊形社便空決治展馬科司五基眼書非則聽白卻界達光放強即像難且權思王象完設式色路記南品住告類求據程北邊死張該交規萬取拉格望覺術領共確傳師觀清今切院讓識候帶導爭運錯誤庫檔案連線失敗")
_CENTRAL = set("ąćęłńóśźżĄĆĘŁŃÓŚŹŻáčďéěíňřšťúůýžÁČĎÉĚÍŇŘŠŤÚŮÝŽőűŐŰöüÖÜäßľĺŕôâăîșțşţđ")
_WESTERN = set("éèêëàâäáãåçîïíìñôöóòõùûüúýÿœæøßÉÈÊËÀÂÄÁÃÅÇÎÏÍÌÑÔÖÓÒÕÙÛÜÚÝŒÆØ€£§°«»“”‘’–—…¿¡µ±·²³")


def _likely(data: bytes, key: str) -> float:
    """How well a head reads in an encoding: the mean worth of its characters beyond ASCII, 0 if it is not valid in it."""
    codec = CODECS.get(key, key)
    for cut in range(4):  # the head may end within a character
        try:
            text = data[: len(data) - cut].decode(codec)
            break
        except UnicodeDecodeError:
            continue
    else:
        return 0.0
    if any("\x80" <= c <= "\x9f" for c in text):
        return 0.0
    high = [c for c in text if c > "\x7f"]
    if not high:
        return 0.0
    worth = 0.0
    before = " "
    for c, after in zip(text, text[1:] + " "):
        if c > "\x7f":
            o = ord(c)
            if key in ("windows1251", "koi8r"):
                # words of one script, capitals only at their start
                latin = before.isascii() and before.isalpha() or after.isascii() and after.isalpha()
                worth += -0.5 if latin else 0.9 if "а" <= c <= "я" or c in "ёЁ" else 0.8 if "А" <= c <= "Я" and not ("а" <= before <= "я") else 0.0
            elif key in ("windows1250", "iso88592"):
                fits = c in _CENTRAL and not (c.isupper() and before.islower())
                worth += (0.69 if c in _WESTERN else 0.9) if fits else -0.3
            elif key == "windows1252":
                worth += 0.7 if c in _WESTERN and not (c.isupper() and before.islower()) else 0.1
            elif key in ("shiftjis", "eucjp"):
                worth += 1.0 if 0x3040 <= o <= 0x30FF else 0.8 if 0x4E00 <= o <= 0x9FFF and (c in _TRADITIONAL or c in _SIMPLIFIED) else 0.55 if 0x4E00 <= o <= 0x9FFF or 0x3000 <= o <= 0x303F else -0.5 if 0xFF61 <= o <= 0xFF9F else 0.0
            elif key == "euckr":
                worth += 0.95 if 0xAC00 <= o <= 0xD7A3 else 0.3 if 0x4E00 <= o <= 0x9FFF else 0.0
            else:
                common = _SIMPLIFIED if key == "gb18030" else _TRADITIONAL
                worth += 1.0 if c in common else 0.5 if 0x4E00 <= o <= 0x9FFF or 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF5E else 0.0
        before = c
    return worth / len(high)


def looks_utf16(data: bytes) -> bool:
    """Whether zeros sit mostly in every other byte, as in UTF-16 without a mark."""
    even, odd = data[0::2].count(0), data[1::2].count(0)
    half = max(1, len(data) // 2)
    return max(even, odd) > 0.4 * half and min(even, odd) < 0.1 * half


def is_binary(data: bytes) -> bool:
    """Whether a head of 8 KiB is binary: no mark, not like UTF-16, and more than one byte in twenty is zero."""
    data = data[:8192]
    if not data or any(data.startswith(m) for m, _ in BOMS) or 0 not in data or looks_utf16(data):
        return False
    return data.count(0) > 0.05 * len(data)


def file_heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, size, zeros, encoding, binary, archive`` of files, from their first 64 KiB; no more of them is read."""
    from .archive import kind_of

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    data = f.read(65536)
                    size = f.seek(0, 2)
                rows.append((path, size, data[:8192].count(0), detect_encoding(data), is_binary(data), kind_of(path, data)))
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "size", "zeros", "encoding", "binary", "archive"), r)) for r in rows], schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("zeros", pa.int64()), ("encoding", pa.string()), ("binary", pa.bool_()), ("archive", pa.string())]))

    rows = [(p,) for p in ([paths] if isinstance(paths, str) else paths)]
    return spark.createDataFrame(rows, "file string").repartition(min(len(rows), 200) or 1).mapInArrow(look, "file string, size long, zeros long, encoding string, binary boolean, archive string")


def open_log(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """Lines of files of any kind: archives, or plain files in the encoding given, else in the detected one.

    ValueError for binary files. What the driver reads is one small row a path it was given.
    """
    from .archive import read_archives

    heads = file_heads(spark, paths).collect()
    if bad := [r["file"] for r in heads if r["binary"] and not r["archive"]]:
        raise ValueError(f"binary file: {bad[0]}")
    out = None
    for key in sorted({r["encoding"] for r in heads if not r["archive"]}):
        some = read_lines(spark, [r["file"] for r in heads if not r["archive"] and r["encoding"] == key], encoding or key)
        out = some if out is None else out.unionByName(some)
    if packed := [r["file"] for r in heads if r["archive"]]:
        some = read_archives(spark, packed).select("file", "line", F.lit(None).cast("long").alias("byte"), "text")
        out = some if out is None else out.unionByName(some)
    return out
