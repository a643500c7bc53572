"""Csv rows and record maps against plain Python checks."""

import csv
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators.rejects import csv_loaded, csv_rejects, p5_loaded, read_rows, record_rejects

HEAD = "ts,level,session,status,ms,msg"


def reference(line, header):
    line = line[:-1] if line.endswith("\r") else line
    d = max(",;\t|", key=header.count)
    names = header.split(d)
    cells, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                k = line.find('"', j)
                if k < 0:
                    return "quoting"
                if line[k : k + 2] == '""':
                    j = k + 2
                    continue
                break
            cells.append(line[i + 1 : k].replace('""', '"'))
            i = k + 1
            if i < len(line) and line[i] != d:
                return "quoting"
        else:
            k = line.find(d, i)
            k = len(line) if k < 0 else k
            cell = line[i:k]
            if '"' in cell:
                return "quoting"
            cells.append(cell)
            i = k
        if i >= len(line):
            break
        i += 1
    if len(cells) != len(names):
        return "columns"
    import datetime

    for n, c in zip(names, cells):
        if n == "ts":
            if not re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", c):
                return "value"
            try:
                datetime.datetime.strptime(c, "%Y-%m-%d %H:%M:%S")
            except ValueError:
                return "value"
        if n == "level" and c.upper() not in "TRACE DEBUG INFO WARN WARNING ERROR FATAL CRITICAL".split():
            return "value"
        if n == "status" and not re.fullmatch(r"[1-5]\d\d", c):
            return "value"
        if n == "ms" and not re.fullmatch(r"\d+(\.\d+)?", c):
            return "value"
    return None


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_rows_agree_with_plain_checks(d):
    rng = random.Random(5)
    header = HEAD.replace(",", d)
    lines = []
    for _ in range(1500):
        cells = [rng.choice(["2026-02-28 10:00:00", "2026-02-30 10:00:00", "x", '"2024-02-29 23:59:59"']), rng.choice(["INFO", "info", "EROR", '"WARN"']), rng.choice(["S-1", "", '""']), rng.choice(["200", "600", "2O0"]), rng.choice(["1.5", "12", "1.", "-1"]), rng.choice(["ok", '"a ""b"" c"', f'"x{d}y"', '"open', 'st"ray', '"a" ', "é" * 3])]
        line = d.join(cells)
        lines.append(rng.choice([line, line, line, line + d + "x", line + "\r", line.rsplit(d, 1)[0], ""]))
    reason, at, cells, _ = read_rows(pa.array(lines), header)
    assert list(reason) == [reference(x, header) for x in lines]
    good = [x for x, r in zip(lines, reason) if r is None]
    want = [next(csv.reader([x.removesuffix("\r")], delimiter=d)) for x in good]
    kept = [i for i, k in enumerate(at) if reason[k] is None]
    assert [cells["msg"][i].as_py() for i in kept] == [w[-1] for w in want]


def test_inner_line_breaks_and_long_cells():
    long = "y" * 3_000_000
    lines = ['2026-01-01 00:00:00,INFO,s,200,1,"a\nb\rc"', f"2026-01-01 00:00:00,INFO,s,200,1,{long}", "a,b"]
    reason, at, cells, _ = read_rows(pa.array(lines), HEAD)
    assert list(reason) == [None, None, "columns"]
    assert cells["msg"][0].as_py() == "a\nb\rc" and cells["msg"][1].as_py() == long


def test_csv_tables(spark):
    doc = spark.createDataFrame([("a", "csv"), ("a", "csv"), ("b", "csv"), ("c", "log"), (None, "csv")], "file string, kind string")
    rows = [("a", 1, HEAD), ("a", 3, "bad"), ("a", 2, "2026-01-01 00:00:00,INFO,s,200,1,m"), ("a", 2, "2026-01-01 00:00:00,INFO,s,200,1,m"), ("a", 4, None), ("a", 5, ""), ("c", 1, "x,y"), ("c", 2, "z"), ("b", 7, None), (None, 1, "q"), ("a", None, "q")]
    lines = spark.createDataFrame(rows, "file string, line_no long, text string").withColumn("header", F.lit("clash")).withColumn("kind", F.lit("clash"))
    assert {tuple(r) for r in csv_rejects(lines, doc).collect()} == {("a", 3, "columns", None, "bad"), ("a", 5, "columns", None, "")}
    got = csv_loaded(lines, doc).collect()
    assert [(r["line"], r["level"], r["status"], r["ms"], r["msg"]) for r in got] == [(2, "INFO", 200, 1.0, "m")]
    assert csv_rejects(lines.limit(0), doc).count() == 0 and csv_rejects(lines, doc.limit(0)).count() == 0


def test_records(spark):
    g = {"session": "s", "status": "200", "ms": "1.5", "bytes": "7"}
    s = {"session": "s", "action": "INSERT", "query": "it''s 'fine' \"x\" "}
    rows = [("a", 1, "generic", g), ("a", 2, "generic", g | {"ms": "1e5"}), ("a", 3, "generic", g | {"note": "x"}), ("a", 4, "generic", g | {"session": "S'1"}), ("a", 5, "sql", s | {"query": "note 'it''s \"search\" again'"}), ("a", 6, "sql", s | {"query": '"open'}), ("a", 7, "sql", {"session": "s", "action": "SELCT", "query": ""}), ("a", 8, "other", g), ("a", 9, None, g), ("a", 10, "generic", None), ("a", 11, "generic", g | {"status": None}), ("a", 12, "sql", {}), ("a", 12, "sql", {})]
    df = spark.createDataFrame(rows, "file string, line long, kind string, fields map<string,string>")
    assert {(r["line"], r["reason"]) for r in record_rejects(df).collect()} == {(2, "value"), (3, "columns"), (4, "quoting"), (6, "quoting"), (7, "value"), (10, "columns"), (11, "value"), (12, "columns")}


def test_both_tables_are_loaded(spark, tmp_path):
    g = {"session": "s", "status": "200", "ms": "1.5", "bytes": "90071992547409930"}
    s = {"session": "", "action": "INSERT", "query": "it 'fine'"}
    rows = [("a", 1, "generic", g), ("a", 1, "generic", g), ("a", 2, "generic", g | {"status": "600"}), ("a", 3, "sql", s), ("a", 4, "sql", s | {"query": '"open'}), ("a", 5, "other", g), ("a", 6, None, g), ("a", 7, "sql", None)]
    spark.createDataFrame(rows, "file string, line long, kind string, fields map<string,string>").write.parquet(f"{tmp_path}/parsed_record.parquet")
    lines = [("c", 1, HEAD), ("c", 2, "2026-01-01 00:00:00,INFO,s,200,1,m"), ("c", 3, "bad")]
    spark.createDataFrame(lines, "file string, line_no long, text string").write.parquet(f"{tmp_path}/line_view.parquet")
    spark.createDataFrame([("c", "csv"), ("a", "log")], "file string, kind string").write.parquet(f"{tmp_path}/doc.parquet")
    got = {(r["tbl"], r["file"], r["line"], r["kind"], r["level"], r["session"], r["status"], r["ms"], r["msg"], r["bytes"], r["action"], r["query"]) for r in p5_loaded(spark, str(tmp_path)).collect()}
    assert got == {
        ("line_view", "c", 2, None, "INFO", "s", 200, 1.0, "m", None, None, None),
        ("parsed_record", "a", 1, "generic", None, "s", 200, 1.5, None, 90071992547409930, None, None),
        ("parsed_record", "a", 3, "sql", None, "", None, None, None, None, "INSERT", "it 'fine'"),
    }


def test_failing_cells_are_named_and_all_columns_loaded(spark):
    doc = spark.createDataFrame([("a", "csv"), ("b", "csv")], "file string, kind string")
    rows = [(f, i, t) for f, ts in {"a": ["bytes;status;ms;note", "9;200;1.5;x", "8;20x;y;z", '7;200;2;"p;""q"', '6;200;"2;r', "5;99;z"], "b": ["a b c", "1 2 3"]}.items() for i, t in enumerate(ts, 1)]
    lines = spark.createDataFrame(rows, "file string, line_no long, text string")
    assert {tuple(r) for r in csv_rejects(lines, doc).collect()} == {("a", 3, "value", "status", "20x"), ("a", 5, "quoting", None, '6;200;"2;r'), ("a", 6, "columns", None, "5;99;z")}
    got = {(r["file"], r["line"]): (r["status"], r["ms"], r["other"]) for r in csv_loaded(lines, doc).collect()}
    assert got == {("a", 2): (200, 1.5, {"bytes": "9", "note": "x"}), ("a", 4): (200, 2.0, {"bytes": "7", "note": 'p;"q'}), ("b", 2): (None, None, {"a b c": "1 2 3"})}
    records = spark.createDataFrame([("a", 1, "generic", {"session": "s", "status": "700", "ms": "1", "bytes": "x"}), ("a", 2, "sql", {"session": "'s", "action": "SELECT", "query": "q"}), ("a", 3, "sql", {"action": "SELECT"})], "file string, line long, kind string, fields map<string,string>")
    assert {tuple(r) for r in record_rejects(records).collect()} == {("a", 1, "value", "bytes", "x"), ("a", 2, "quoting", "session", "'s"), ("a", 3, "columns", None, '{"action":"SELECT"}')}
