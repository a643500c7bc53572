"""Problem 3: text that came out of a wrong character decoding - find it and restore it.

1. Lines are reduced to their phrases with non-ASCII characters, and these to a vocabulary with the number of files and
   lines that hold each phrase (``vocabulary``). All decisions are made on distinct phrases.
2. Phrases are joined with clean near-twins on their text stripped of non-ASCII characters, aligned character by character,
   and what several twins agree on is the learned mapping (``near_twins``), whichever encodings it came from.
3. Every phrase is also undone by every pair of encodings of CODECS (decoded with D, was in E), once or repeatedly, whole or
   in the run that D can write; where that gives a cleaner phrase of the vocabulary, the pair is learned as well (``twins``,
   ``aligned``). This extends the mapping to characters that no twin has, and to repeated decodings.
4. Phrases without a twin are decided by what was learned: mapping, characters, pairs of encodings; where the phrase does not
   look wrong by itself, the restored text must read more like the vocabulary (``decided``).

Defined results
* the replacement character, C1 controls and private-use characters are garbled (not always restorable: ``restored`` null);
* text in any script, in capitals, and symbols are no case unless undoing a decoding gives a better phrase;
* null and ASCII-only texts are no case; repeated rows count once; null file or line numbers are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join, table
from . import near_twins
from .oddness import odd, telling

#: encoding keys -> codecs
CODECS = {
    "utf8": "utf-8",
    "windows1252": "cp1252",
    "windows1250": "cp1250",
    "windows1251": "cp1251",
    "koi8r": "koi8_r",
    "iso88592": "iso8859_2",
    "shiftjis": "cp932",
    "eucjp": "euc_jp",
    "euckr": "cp949",
    "gb18030": "gb18030",
    "big5": "big5",
}
SINGLE = ["windows1252", "windows1250", "windows1251", "koi8r", "iso88592"]
#: a phrase: words with non-ASCII characters, one space apart; ends at white space, quotes, colons, commas and semicolons
PHRASE = r"""[A-Za-z']*[^\x00-\x7F][^\x00-\x20":;,]*(?: [^\x00-\x20":;,]*[^\x00-\x7F][^\x00-\x20":;,]*)*"""
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


class Codecs:
    """Strict encoding and decoding as browsers do it: undefined bytes of single-byte sets are C1 controls."""

    def __init__(self) -> None:
        self.back: dict[str, list[str]] = {}
        self.there: dict[str, dict[str, int]] = {}
        for k in SINGLE:
            row = []
            for b in range(256):
                try:
                    row.append(bytes([b]).decode(CODECS[k]))
                except UnicodeDecodeError:
                    row.append(chr(b))
            self.back[k], self.there[k] = row, {c: i for i, c in enumerate(row)}

    def encode(self, text: str, k: str) -> bytes | None:
        if k in self.there:
            t = self.there[k]
            try:
                return bytes([t[c] for c in text])
            except KeyError:
                return None
        try:
            return text.encode(CODECS[k])
        except UnicodeEncodeError:
            return None

    def decode(self, data: bytes, k: str) -> str | None:
        if k in self.back:
            row = self.back[k]
            return "".join([row[b] for b in data])
        try:
            return data.decode(CODECS[k])
        except UnicodeDecodeError:
            return None

    def partly(self, text: str, k: str) -> tuple[str, int]:
        """Text which ``k`` can write with its UTF-8 sequences decoded and all else as it was, and how many those are."""
        data = self.encode(text, k)
        if k not in self.back:
            got = self.decode(data, "utf8")
            return (got, sum(1 for c in got if not c.isascii())) if got is not None else (text, 0)
        out, at, n = [], 0, 0
        for m in _SEQUENCE.finditer(data):
            c = self.decode(m[0], "utf8")
            if c is not None:
                out += [text[at : m.start()], c]
                at, n = m.end(), n + 1
        return "".join(out) + text[at:], n

    def runs(self, text: str, k: str) -> list[tuple[int, int]]:
        """Maximal spans with non-ASCII characters which ``k`` can write."""
        out, a = [], None
        for i, c in enumerate(text + "\udfff"):
            if i < len(text) and (c in self.there[k] if k in self.there else self.encode(c, k) is not None):
                a = i if a is None else a
            elif a is not None:
                if not text[a:i].isascii():
                    out.append((a, i))
                a = None
        return out


def undone(phrase: str, codecs: Codecs) -> list[tuple[str, str, int]]:
    """What undoing wrong decodings gives: (chain of ``D>E`` steps, text, UTF-8 sequences undone)."""
    out: dict[str, tuple[str, int]] = {}
    front = [(phrase, "", 0)]
    while front:  # ends: no step to UTF-8 makes a text longer, and every text is looked at once
        nxt = []
        for text, chain, n in front:
            step = f"{chain}," if chain else ""
            utf8_only = bool(chain) and not odd(text)
            for d in CODECS:
                if d == "utf8":
                    continue  # other encodings read as UTF-8 lose characters
                whole = codecs.encode(text, d)
                if whole is not None and not whole.isascii():
                    for e in CODECS:
                        if e == d or (e != "utf8" and utf8_only):
                            continue
                        v = codecs.decode(whole, e)
                        if v is None or v == text or v in out or v == phrase:
                            continue
                        m = sum(1 for c in v if not c.isascii()) if e == "utf8" else 0
                        out[v] = (f"{step}{d}>{e}", n + m)
                        if e == "utf8":
                            nxt.append((v, f"{step}{d}>{e}", n + m))
                v, m = text, 0
                for a, b in reversed(codecs.runs(text, d)):
                    got, n_got = codecs.partly(text[a:b], d)
                    v, m = v[:a] + got + v[b:], m + n_got
                if m and v not in out and v != phrase:
                    out[v] = (f"{step}{d}>utf8*", n + m)
                    nxt.append((v, f"{step}{d}>utf8*", n + m))
        # a repeated decoding leaves text which is still odd
        front = [x for x in nxt if not x[0].isascii()]
    return [(c, v, m) for v, (c, m) in out.items()]


def stripped(phrase: str) -> str:
    return re.sub(r"[^\x00-\x7f]+", "", phrase)


def vocabulary(lines: DataFrame, doc: DataFrame | None = None) -> DataFrame:
    """``phrase, n_files, n_lines, keys`` of all phrases with non-ASCII characters; ``keys`` are the encodings with which their
    files were decoded (``doc``: the override, else the detected one), at most as many as there are."""
    rows = lines.where("text is not null and octet_length(text) <> length(text)")
    said = rows.select("file", F.explode(F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0))).alias("phrase")).groupBy("phrase", "file").agg(F.count("*").alias("n"))
    if doc is None:
        said = said.withColumn("key", F.lit(None).cast("string"))
    else:
        used = doc.where("file is not null").groupBy("file").agg(F.first(F.coalesce("encoding_override", "detected"), True).alias("key"))
        said = lookup_join(said, used, ["file"], "left", salt_by=F.col("phrase"))
    return said.groupBy("phrase").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), F.collect_set("key").alias("keys"))


_CANDIDATE = "phrase string, skeleton string, odd boolean, chain string, restored string, restored_skeleton string, restored_odd boolean, sequences int"


def _undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codecs = Codecs()
    names = [c.split()[0] for c in _CANDIDATE.split(", ")]
    for pdf in batches:
        out = []
        for p in pdf["phrase"]:
            o, s = odd(p), stripped(p)
            out.append((p, s, o, None, None, None, None, 0))
            out.extend((p, s, o, c, v, stripped(v), odd(v), n) for c, v, n in undone(p, codecs))
        yield pd.DataFrame(out, columns=names)


def candidates(vocab: DataFrame) -> DataFrame:
    """Every way to undo every phrase, and one row without a way for the phrase itself."""
    return vocab.select("phrase").repartition(F.col("phrase")).mapInPandas(_undo, _CANDIDATE)


def twins(ways: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ways which lead to a phrase of the vocabulary that is the cleaner of the two."""
    clean = vocab.select(F.col("phrase").alias("restored"), F.col("n_files").alias("clean_files"), F.col("n_lines").alias("clean_lines"))
    hits = ways.where("chain is not null").join(clean, "restored").join(vocab, "phrase")
    better = (F.col("odd") & ~F.col("restored_odd")) | ((F.col("odd") == F.col("restored_odd")) & (F.struct("clean_files", "clean_lines") > F.struct("n_files", "n_lines")))
    # a near-twin has the same ASCII characters, unless single-byte halves of longer characters were ASCII
    near = (F.col("skeleton") == F.col("restored_skeleton")) | (F.length("restored_skeleton") < F.length("skeleton"))
    return hits.where(better & near)


def _became(p: str, v: str, chain: str, codecs: Codecs) -> dict[str, str]:
    """What stands in ``p`` for the non-ASCII characters of ``v``: garbled sequence -> character."""
    out = {}
    steps = [s.rstrip("*").split(">") for s in chain.split(",")]
    for c in set(v):
        t: str | None = c
        for d, e in reversed(steps):
            data = codecs.encode(t, e) if t is not None else None
            t = codecs.decode(data, d) if data is not None else None
        if t and not c.isascii() and t != c and t in p and not t.isascii():
            out[t] = c
    return out


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codecs = Codecs()
    for pdf in batches:
        out = [(p, v, c, t, b, telling(p, t)) for p, v, c in zip(pdf["phrase"], pdf["restored"], pdf["chain"]) for t, b in _became(p, v, c, codecs).items()]
        yield pd.DataFrame(out, columns=["phrase", "restored", "chain", "garbled", "became", "telling"])


def aligned(ways: DataFrame) -> DataFrame:
    """``phrase, restored, chain, garbled, became, telling``: the ways by UTF-8 steps, character by character."""
    utf8 = F.col("chain").rlike(r"utf8[*]?$") & ~F.col("restored_odd")
    return ways.where(utf8).select("phrase", "restored", "chain").mapInPandas(_align, "phrase string, restored string, chain string, garbled string, became string, telling boolean")


def decided(vocab: DataFrame) -> DataFrame:
    """``phrase, restored`` of every garbled phrase (``restored`` null where nothing certain is left)."""
    ways = cut(candidates(vocab))
    hits = cut(twins(ways, vocab))
    # transformations: at most one row for each chain of encodings
    learned = hits.groupBy("chain").agg(F.countDistinct("phrase").alias("pairs"))
    by_twin = hits.groupBy("phrase").agg(F.max_by("restored", F.struct("clean_files", "clean_lines", "restored")).alias("restored"))
    rest = ways.join(by_twin.select("phrase"), "phrase", "left_anti")
    # near-twins on the stripped text and what they teach
    cells = cut(near_twins.replacements(near_twins.near_twins(vocab)))
    mapping = cut(near_twins.mappings(cells))
    alone = vocab.join(by_twin.select("phrase"), "phrase", "left_anti")
    twin = cut(near_twins.confirmed(cells, mapping).join(by_twin.select("phrase"), "phrase", "left_anti"))
    by_map = near_twins.applied(alone, mapping)
    # one single-byte set for another may give text that does not look wrong by itself: which of both reads like the rest?
    twice = cut(learned.where("pairs >= 3 and not chain like '%utf8%'"))
    plain = lookup_join(rest.where("chain is not null and not odd and not restored_odd"), twice, ["chain"], "inner", salt_by=F.col("phrase"))
    ways_out = by_map.unionByName(plain.select("phrase", "restored", "chain", F.lit(False).alias("odd"), F.lit(False).alias("telling")))
    # what leads to a phrase of the vocabulary must lead to the more frequent one
    there = vocab.select(F.col("phrase").alias("restored"), F.struct("n_files", "n_lines").alias("there"))
    here = vocab.select("phrase", "keys", F.struct("n_files", "n_lines").alias("here"))
    ways_out = cut(ways_out.join(here, "phrase").join(there, "restored", "left").where("there is null or there > here").drop("here", "there"))
    unsure = ways_out.where("not odd and not telling")
    gains = unsure.join(near_twins.fluency(alone.join(twin.select("phrase"), "phrase", "left_anti"), unsure), ["phrase", "restored"])
    same = F.exists("keys", lambda k: F.col("chain").startswith(F.concat(k, F.lit(">"))))
    fluent = gains.where((F.col("gain") >= near_twins.MARGIN) | same & (F.col("gain") >= near_twins.SAME_KEY_MARGIN)).select("phrase", "restored", F.col("gain").alias("worth"))
    plainly = ways_out.where("odd or telling").select("phrase", "restored", F.lit(100.0).alias("worth"))
    by_map_or_sense = fluent.unionByName(plainly).unionByName(twin.select("phrase", "restored", F.lit(200.0).alias("worth"))).groupBy("phrase").agg(F.max_by("restored", F.struct("worth", "restored")).alias("restored"))
    # characters: as many rows as there are characters and encodings in use
    taught = cut(aligned(hits).select("garbled", "became").distinct().withColumn("known", F.lit(True)))
    met = lookup_join(aligned(rest), taught, ["garbled", "became"], "left")
    spelt = met.groupBy("phrase", "restored", "chain").agg(F.min(F.coalesce("known", F.lit(False))).alias("all_known"), F.max("telling").alias("telling")).where("all_known and telling").select("phrase", "restored", "chain", F.lit(True).alias("spelt"))
    # as many chains as encodings in use, yet checked
    known = lookup_join(rest, cut(learned), ["chain"], "left", salt_by=F.col("phrase")).join(spelt, ["phrase", "restored", "chain"], "left")
    utf8 = F.col("chain").endswith("utf8") | F.col("chain").endswith("utf8*")
    # by a transformation that twins taught, by UTF-8 sequences, which do not arise by chance, or by characters that twins
    # taught, where one sequence is enough
    sure = utf8 & ~F.col("restored_odd") & (F.col("odd") | (F.col("sequences") >= 2) & F.col("pairs").isNotNull() | F.coalesce("spelt", F.lit(False)))
    lost = F.coalesce(F.col("odd"), F.lit(False)) & F.col("phrase").rlike(r"[\x{FFFD}\x{80}-\x{9F}\x{E000}-\x{F8FF}]")
    # single-byte encodings after a UTF-8 step: garbled, but not certain which they were
    lost |= F.coalesce(F.col("odd") & F.col("chain").contains(">utf8") & ~F.col("restored_odd"), F.lit(False))
    single = F.col("odd") & ~F.coalesce(F.col("restored_odd"), F.lit(True)) & (F.col("pairs") >= 2)
    by_rule = (
        known.groupBy("phrase")
        .agg(
            F.max(F.coalesce(sure, F.lit(False))).alias("sure"),
            F.max(lost).alias("lost"),
            F.max(F.coalesce(single, F.lit(False))).alias("single"),
            F.max_by("restored", F.when(F.coalesce(sure | single, F.lit(False)), F.struct(F.coalesce("pairs", F.lit(0)), "sequences", "restored"))).alias("restored"),
        )
        .where("sure or lost or single")
        .select("phrase", F.when(F.col("sure") | F.col("single"), F.col("restored")).alias("restored"))
    )
    # by a twin, by rule, by the learned mapping and by sense, in this order; a restored text goes before none
    ranked = by_twin.withColumn("rank", F.lit(3)).unionByName(by_rule.withColumn("rank", F.lit(2))).unionByName(by_map_or_sense.withColumn("rank", F.lit(1)))
    out = cut(ranked.groupBy("phrase").agg(F.max_by("restored", F.struct(F.col("restored").isNotNull(), "rank")).alias("restored")))
    # what became a phrase that is garbled itself goes one step on
    again = out.select(F.col("phrase").alias("restored"), F.col("restored").alias("further"), F.lit(True).alias("garbled"))
    return out.join(again, "restored", "left").select("phrase", F.when(F.col("garbled"), F.col("further")).otherwise(F.col("restored")).alias("restored"))


def garbled_lines(lines: DataFrame, doc: DataFrame | None = None) -> DataFrame:
    """``file, line_no, phrase, restored``: the garbled phrases of all lines."""
    rows = lines.where("file is not null and line_no is not null and text is not null and octet_length(text) <> length(text)")
    bad = cut(decided(cut(vocabulary(lines, doc))))
    said = rows.select("file", "line_no", F.explode(F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0))).alias("phrase"))
    return lookup_join(said, bad, ["phrase"], "inner", salt_by=F.col("line_no"))


def restored_lines(lines: DataFrame, doc: DataFrame | None = None) -> DataFrame:
    """``file, line_no, text, restored, whole``: garbled lines with every restorable phrase put right at its place; ``whole`` if nothing was lost."""
    fixes = garbled_lines(lines, doc).groupBy("file", "line_no").agg(F.collect_set(F.struct("phrase", "restored")).alias("fixes"))  # as many as a line has phrases
    texts = lines.select("file", "line_no", "text").where("text is not null and octet_length(text) <> length(text)")
    hit = lookup_join(texts, cut(fixes), ["file", "line_no"], "inner", salt_by=F.col("line_no")).dropDuplicates(["file", "line_no"])
    # the text between the phrases stays, each phrase is looked up once
    put = F.expr("transform(phrases, p -> coalesce(element_at(map_from_entries(fixes), p), p))")
    begin = F.when(F.size("parts") > F.size("phrases"), F.get("parts", F.lit(0))).otherwise("")
    rest = F.when(F.size("parts") > F.size("phrases"), F.slice("parts", 2, F.size("phrases"))).otherwise(F.col("parts"))
    whole = F.concat(begin, F.array_join(F.zip_with(put, rest, lambda p, r: F.concat(p, r)), ""))
    cutup = hit.withColumns({"parts": F.split("text", PHRASE, -1), "phrases": F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0))})
    return cutup.select("file", "line_no", "text", whole.alias("restored"), F.forall("fixes", lambda f: f["restored"].isNotNull()).alias("whole"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no`` of lines in which all or part of the text is garbled."""
    return garbled_lines(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc")).select("file", "line_no").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled lines with their restored text."""
    return restored_lines(table(spark, sf_dir, "line_view"), table(spark, sf_dir, "doc"))
