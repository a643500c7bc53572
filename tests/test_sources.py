"""Files, archives, encodings, scalars and following."""

import bz2
import gzip
import io
import lzma
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.sources import archive, cache
from tidemark.sources import lines as src
from tidemark.streaming import follow


@pytest.mark.parametrize("data,want", [(b"l1\r\nl2\nl3\r\nlast", ["l1", "l2", "l3", "last"]), (b"", []), (b"\xef\xbb\xbfa\nb\n", ["a", "b"]), (b"a\nb", ["a", "b"]), (b"a\rb\n\n\xff\n", ["a\rb", "", "�"])])
def test_line_rules(spark, tmp_path, data, want):
    p = tmp_path / "x.log"
    p.write_bytes(data)
    got = src.read_lines(spark, str(p)).orderBy("line").collect()
    assert [r["text"] for r in got] == want and [r["line"] for r in got] == list(range(1, len(want) + 1))


def test_numbers_and_bytes_over_splits(spark, tmp_path):
    p = tmp_path / "big.log"
    body = [f"line {i} " + "é" * (i % 7) for i in range(20000)]
    p.write_text("\n".join(body) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = src.read_lines(spark, str(p))
        got = df.orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in got] == body
    data = p.read_bytes()
    assert all(data[r["byte"] :].startswith(r["text"].encode()) for r in got[::997])
    assert src.line_at_byte(df, got[500]["byte"] + 2).first()["line"] == 501


@pytest.mark.parametrize("key,text", [("windows1252", "Größe €\nx"), ("shiftjis", "日本\nx"), ("koi8r", "ошибка\nx"), ("utf16le", "WARN один\r\nx\n"), ("iso88592", "żółć\nx"), ("gb18030", "错误\nx"), ("euckr", "오류\nx")])
def test_encodings(spark, tmp_path, key, text):
    p = tmp_path / "e.log"
    codec = {"shiftjis": "cp932", "koi8r": "koi8_r", "iso88592": "iso8859_2", "euckr": "cp949", "windows1252": "cp1252", "utf16le": "utf-16-le"}.get(key, key)
    p.write_bytes((b"\xff\xfe" if key == "utf16le" else b"") + text.encode(codec))
    assert [r["text"] for r in src.read_lines(spark, str(p), key).orderBy("line").collect()] == [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]


def test_detection():
    assert [src.detect_encoding(x) for x in (b"abc", "é".encode(), "é".encode()[:1], b"\xe9t\xe9 ", b"\xff\xfea\0", "abcdefgh".encode("utf-16-le"))] == ["utf8", "utf8", "utf8", "windows1252", "utf16le", "utf16le"]
    heads = {"windows1252": "Größe überschritten, dépôt fermé", "shiftjis": "ファイルが見つかりません 時刻", "eucjp": "接続が切れました エラー", "euckr": "연결이 끊어졌습니다 오류", "gb18030": "错误：文件不能打开", "big5": "錯誤：檔案不能開啟", "windows1251": "Ошибка записи в журнал", "koi8r": "Ошибка записи в журнал", "windows1250": "Příliš žluťoučký kůň", "iso88592": "Zażółć gęślą jaźń ąśź"}
    assert {k: src.detect_encoding(b"2026-03-01 ERROR " + t.encode(src.CODECS.get(k, k))) for k, t in heads.items()} == {k: k for k in heads}
    assert src.is_binary(bytes([1, 2, 0] * 500)) and not src.is_binary(b"a" * 100 + b"\0") and not src.is_binary("text".encode("utf-16-le") * 50)


@pytest.mark.parametrize("key", ["utf16le", "utf16be", "shiftjis", "gb18030", "windows1251"])
def test_numbers_and_bytes_in_other_encodings(spark, tmp_path, monkeypatch, key):
    """Lines over many splits, with characters whose bytes look like line ends in UTF-16."""
    from tidemark.sources import files

    monkeypatch.setattr(files, "RANGE", 4096)
    monkeypatch.setattr(files, "STEP", 100)
    odd = "\u0a05\u0100\u010a" if key.startswith("utf16") else "д" if key == "windows1251" else "時"
    body = [f"line {i} {odd * (i % 5)}" for i in range(3000)]
    p, codec = tmp_path / "e.log", src.CODECS.get(key, key)
    p.write_bytes("\r\n".join(body).encode(codec))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = src.read_lines(spark, str(p), key).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["text"] for r in got] == body and [r["line"] for r in got] == list(range(1, 3001))
    data = p.read_bytes()
    assert all(data[r["byte"] :].startswith(r["text"].encode(codec)) for r in got)


def test_numbering_shuffles_no_text(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("a\nb\n")
    plan = src.read_lines(spark, str(p))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all("value" not in x and "text" not in x for x in exchanges)


def test_open_log_finds_kind_and_encoding(spark, tmp_path):
    texts = {"a.log": "один\nдва\n".encode("koi8_r") + b"Error\n", "b.log": "één\ntwee".encode(), "c.log": "\ufeffx\ny".encode("utf-16-le")}
    for n, d in texts.items():
        (tmp_path / n).write_bytes(d)
    (tmp_path / "d.log.gz").write_bytes(gzip.compress("p\nq\n".encode()))
    df = src.open_log(spark, [str(tmp_path / n) for n in (*texts, "d.log.gz")])
    got = {}
    for r in df.orderBy("file", "line").collect():
        got.setdefault(r["file"].rsplit("/", 1)[-1], []).append(r["text"])
    assert got == {"a.log": ["один", "два", "Error"], "b.log": ["één", "twee"], "c.log": ["x", "y"], "d.log.gz": ["p", "q"]}
    (tmp_path / "bin").write_bytes(bytes([0, 1, 2] * 4000))
    with pytest.raises(ValueError):
        src.open_log(spark, str(tmp_path / "bin"))


def test_command_line(spark, tmp_path):
    from tidemark.__main__ import main

    def run(*args):
        out = io.StringIO()
        return main([str(a) for a in args], spark, out), out.getvalue()

    p, e, b, w = (tmp_path / n for n in ("s.log", "empty.log", "bin", "w.log"))
    p.write_text("2026-09-04 INFO start\n2026-09-04 ERROR disk full\n2026-09-04 INFO stop\n")
    e.write_text("")
    b.write_bytes(bytes([0, 1, 2] * 4000))
    w.write_text("open ticket\ngolden hour\n")
    code, text = run("count", p)
    assert code == 0 and "Lines: 3" in text and "Size: 70 B (70 bytes)" in text
    assert "Baris: 3" in run("--lang", "id", "count", p)[1]
    assert run("grep", "ERROR", p) == (0, "2026-09-04 ERROR disk full\n") and run("grep", "-n", "ERROR", p) == (0, "2:2026-09-04 ERROR disk full\n")
    assert run("grep", "-c", "ERROR", p) == (0, "1\n") and run("grep", "FATAL", p) == (1, "") and run("grep", "-c", "FATAL", p) == (1, "0\n")
    assert run("--lang", "en", "grep", "-c", "en", w) == (0, "2\n") and run("grep", "-c", "x", e) == (1, "0\n")
    assert [run(*a)[0] for a in (("grep", "x", tmp_path / "none"), ("count", b), ("grep", "x", b), ("count",), ("grep", "x"), ())] == [2] * 6


def test_archives(spark, tmp_path):
    log = b"one\r\ntwo\nthree"
    paths = []

    def put(name, data):
        (tmp_path / name).write_bytes(data)
        paths.append(str(tmp_path / name))

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("readme.md", "x" * 999)
        f.writestr("a/app.log", log)
        f.writestr("b.txt", bytes([0, 0, 1] * 5000) + b"x")
    put("x.zip", z.getvalue())
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        i = tarfile.TarInfo("app.log")
        i.size = len(log)
        f.addfile(i, io.BytesIO(log))
    for name, pack in (("x.tar", lambda b: b), ("x.tar.gz", gzip.compress), ("x.tar.bz2", bz2.compress), ("x.tar.xz", lzma.compress)):
        put(name, pack(t.getvalue()))
    put("app.log.gz", gzip.compress(log))
    put("app.log.xz", lzma.compress(log))
    put("plain.log", log)
    got = archive.read_archives(spark, paths).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("ls")).collect()
    assert len(got) == len(paths) and all([(x["line"], x["text"]) for x in r["ls"]] == [(1, "one"), (2, "two"), (3, "three")] for r in got)
    with pytest.raises(archive.ArchiveError):
        archive.unpack("x.7z", b"7z\xbc\xaf\x27\x1c")
    with pytest.raises(archive.ArchiveError):
        archive.unpack("x.zip", b"PK\x03\x04broken")


def test_cache(spark, tmp_path):
    p = tmp_path / "c.log"
    p.write_text("a\nb\n")
    assert cache.cached_lines(spark, [str(p)], str(tmp_path / "cache")).count() == 2
    p.write_text("a\nb\nc\n")
    assert cache.cached_lines(spark, [str(p)], str(tmp_path / "cache")).count() == 3


def test_follow(spark, tmp_path):
    p, out, cp = tmp_path / "f.log", str(tmp_path / "out"), str(tmp_path / "cp")
    p.write_text("a\nb\npart")

    def run():
        import time

        rows = lambda: spark.read.schema(follow.SCHEMA).parquet(out) if os.path.exists(out) else spark.createDataFrame([], follow.SCHEMA)
        q = follow.follow(spark, str(p)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(processingTime="200 milliseconds").start()
        try:
            before, end = rows().count(), time.time() + 30
            while rows().count() == before and time.time() < end:
                time.sleep(1)
            time.sleep(2)
        finally:
            q.stop()
        return {(r["generation"], r["line"], r["text"]) for r in rows().collect()}

    assert run() == {(0, 1, "a"), (0, 2, "b")}
    with open(p, "a") as f:
        f.write("ial\nc\n")
    assert run() == {(0, 1, "a"), (0, 2, "b"), (0, 3, "partial"), (0, 4, "c")}
    p.write_text("new\n")
    assert (1, 1, "new") in run()


def test_identity(tmp_path):
    p = tmp_path / "i.log"
    p.write_text("a\n")
    seen = follow.identity(str(p))
    assert follow.decide(seen, str(p)) == "unchanged"
    p.write_text("a\nb\n")
    assert follow.decide(seen, str(p)) == "appended"
    p.write_text("x\nb\n")
    assert follow.decide(seen, str(p)) == "replaced"
    p.write_text("a")
    assert follow.decide(seen, str(p)) == "replaced"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalars.base64_text(F.lit("w6kg YQ"))) == "é a" and one(scalars.base64_text(F.lit("#"))) is None and one(scalars.base64_text(F.lit("_-8="))) == one(scalars.base64_text(F.lit("/+8")))
    assert one(scalars.jwt_parts(F.lit("eyJhIjoxfQ.eyJiIjoyfQ.x")))["payload"] == '{\n  "b": 2\n}' and one(scalars.jwt_parts(F.lit("eyJhIjoxfQ.YWJj"))) is None and one(scalars.jwt_parts(F.lit("x"))) is None
    assert one(scalars.count_text(F.lit(1842291))) == "1.842.291" and one(scalars.size_text(F.lit(1536))) == "1,5 KB" and one(scalars.size_text(F.lit(12))) == "12 B"
    assert one(scalars.hex_rows(F.lit(b"abc\x00defghijklmnop"))) == ["00000000: 61 62 63 00 64 65 66 67  68 69 6a 6b 6c 6d 6e 6f  |abc.defghijklmno|", "00000010: 70 " + "   " * 7 + " " + "   " * 8 + " |p|"]
    assert one(scalars.line_hash(F.lit("a"))) == scalars.short_hash("a") and scalars.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert scalars.tidy_sql("select a from t where x='from b'") == "SELECT a\nFROM t\nWHERE x='from b'" and scalars.pretty_json("{") is None
    assert one(scalars.safe_name(F.lit("Été: My File_1!"))) == "t-my-file_1" and scalars.word_at("ab cd_e", 4) == "cd_e"
    assert scalars.version_key("v1.10.0") > scalars.version_key("1.9.9") and scalars.version_key("1.0-rc1") < scalars.version_key("1.0")


def test_follow_line_longer_than_a_batch(tmp_path, monkeypatch):
    monkeypatch.setattr(follow, "BATCH", 8)
    p = tmp_path / "long.log"
    p.write_text("x" * 50 + "\nnext\n" + "y" * 20)
    reader = follow.FollowReader(str(p))
    at, got = reader.initialOffset(), []
    for _ in range(4):
        rows, at = reader.read(at)
        got += [r[4] for r in rows]
    assert got == ["x" * 50, "next"]
    p.write_text("x" * 50 + "\nnext\n" + "y" * 20 + "\n")
    rows, at = reader.read(at)
    assert [r[4] for r in rows] == ["y" * 20]


def test_workspace(spark, tmp_path):
    from tidemark.sources.workspace import Workspace

    (tmp_path / "a.log").write_bytes("один\nERROR два\nERROR три\n".encode("koi8_r"))
    (tmp_path / "b.log").write_text("ERROR x\nERROR y\n")
    w = Workspace({str(tmp_path / "a.log"): "koi8r", str(tmp_path / "b.log"): None}, "error", last=2)
    w.save(str(tmp_path / "w.json"))
    again = Workspace.load(str(tmp_path / "w.json"))
    assert again == w and {r["text"] for r in again.lines(spark).collect()} == {"ERROR два", "ERROR x", "ERROR y"}
    (tmp_path / "odd.json").write_text("[1]")
    with pytest.raises(ValueError):
        Workspace.load(str(tmp_path / "odd.json"))
    assert Workspace().lines(spark).count() == 0


def test_search_of_followed_lines(spark):
    df = spark.createDataFrame([("f", 0, 1, 0, "ERROR a"), ("f", 0, 2, 8, "b"), ("f", 1, 1, 0, "error c")], follow.SCHEMA)
    assert {r["text"] for r in follow.searched(df, "error").collect()} == {"ERROR a", "error c"}
    assert {tuple(r) for r in follow.new_lines(df).collect()} == {(0, 2, 2), (1, 1, 1)}
