"""Entries of many layouts against a line-by-line reference, block borders, and the defined results."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.log_entries import BLOCK, entries, layouts, level_rank, ranked

COMPONENTS = ["store", "net.accept", "line-index", "segment_io"]
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
MESSAGES = ["flush of segment {n} took {n} ms", "retry {n} after timeout on edge-{n}", "recovered from ERROR state", "fatal=false; last batch: warn", "user u{n} asked"]
NUMBER = {"DEBUG": 20, "INFO": 30, "WARN": 40, "ERROR": 50, "FATAL": 60}


def layout(kind, t, lvl, comp, msg, thread):
    return {
        "bracket": f"[{t:%Y-%m-%d %H:%M:%S}] [{lvl.lower()}] [{comp}] {msg}",
        "log4j": f"{t:%Y-%m-%d %H:%M:%S},123 {lvl:<5} [{thread}] {comp} - {msg}",
        "catalina": f"{t:%d-%b-%Y %H:%M:%S}.250 {lvl} [{thread}] {comp} {msg}",
        "glog": f"{lvl[0]}{t:%m%d %H:%M:%S}.123456  1234 {comp}:77] {msg}",
        "syslog": f"<{16 * 8 + {'DEBUG': 7, 'INFO': 6, 'WARN': 4, 'ERROR': 3, 'FATAL': 2}[lvl]}>{t:%b %e %H:%M:%S} edge-07 {comp}[99]: {msg}",
        "logfmt": f'ts={t:%Y-%m-%dT%H:%M:%SZ} level={lvl.lower()} component={comp} msg="{msg}"',
        "pipe": f"{t:%Y-%m-%d %H:%M:%S}|{lvl[0]}|{comp}|{thread}|{msg}",
        "json": json.dumps({"ts": str(t), "ctx": {"level": "deep"}, "severity": NUMBER[lvl], "logger": comp, "msg": msg}),
        "lines": "{\n" + f'  "component": "{comp}",\n  "tags": {{\n    "level": "inner"\n  }},\n  "severity": "{lvl}", "time": 17{t:%H%M%S}00,\n  "msg": "{msg}"\n' + "}",
    }[kind]


def corpus(seed, n, kinds):
    rng = random.Random(seed)
    lines, want, t = [], [], dt.datetime(2026, 3, 1)
    for _ in range(n):
        t += dt.timedelta(seconds=rng.randrange(1, 90))
        lvl, comp = rng.choice(LEVELS), rng.choice(COMPONENTS)
        msg = rng.choice(MESSAGES).replace("{n}", str(rng.randrange(1, 10**6)))
        text = layout(rng.choice(kinds), t, lvl, comp, msg, rng.choice(["main", "timer", "worker-1", "pool-3-thread-4", "io-2"])).split("\n")
        more = rng.choice([[], [], [], ["\tat a.b.C.run(D.java:7)", "Caused by: x"], ["2026-03-01 10:00:00 replica edge-01 lag 3"], ["SELECT 1", "", " WHERE ts >= '2026-03-01 00:00:00' AND level = 'ERROR'"], ["", None]])
        first = len(lines) + 1
        lines += text + more
        last = first + len(text) + max([0] + [i + 1 for i, x in enumerate(more) if x]) - 1
        want.append((first, last, comp, NUMBER[lvl]))
    return lines, want


KINDS = ["bracket", "log4j", "catalina", "glog", "syslog", "logfmt", "pipe", "json", "lines"]


def frame(spark, files):
    rows = [(f, "edge-07", i, t) for f, ls in files.items() for i, t in enumerate(ls, 1)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows + rows[:20], "file string, host string, line_no long, text string")


def found(df):
    return {(r["file"], r["first_line"], r["last_line"], r["component"], r["rank"]) for r in ranked(df).collect()}


def test_all_layouts(spark):
    files, want = {}, set()
    for k, kinds in enumerate([KINDS, KINDS[:4], KINDS[4:], ["lines", "json"]]):
        files[f"f{k}"], w = corpus(k, 400, kinds)
        want |= {(f"f{k}", *x) for x in w}
    doc = spark.createDataFrame([(f, "log") for f in files] + [("x", "csv")], "file string, kind string")
    assert found(entries(frame(spark, files), doc)) == want


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_block_borders_change_nothing(spark, block):
    lines, w = corpus(9, 120, ["bracket", "lines", "json"])
    lines = ["no entry yet", '  "level": "x"', *lines]
    df = frame(spark, {"f": lines})
    doc = spark.createDataFrame([("f", "log")], "file string, kind string")
    specs = layouts(df)
    got = found(entries(df, doc, specs=specs, block=block))
    assert got == {("f", a + 2, b + 2, c, r) for a, b, c, r in w}


def test_rare_layout_behind_a_shorter_head(spark):
    common = [f"2026-03-01 10:{i // 60:02d}:{i % 60:02d} ERROR {COMPONENTS[i % 4]} write failed{' and again' * (i % 3)}" for i in range(600)]
    rare = [f"2026-03-01 11:00:{i:02d} ERROR {4711 + i} storage - write failed" for i in range(3)]
    df = frame(spark, {"f": common + rare})
    doc = spark.createDataFrame([("f", "log")], "file string, kind string")
    got = {r["first_line"]: r["component"] for r in entries(df, doc).collect()}
    assert got == {i + 1: COMPONENTS[i % 4] for i in range(600)} | {601 + i: "storage" for i in range(3)}


def test_broken_objects_and_sessions(spark):
    lines = ["[2026-03-01 10:00:00] [INFO] [store] a", "{", '  "level": "error",', "plain", "[2026-03-01 10:00:01] [SESSION-9] INSERT x", "go", "[2026-03-01 10:00:02] [error] [store] b\r", "\r", "{", '  "component": "c", "level": "error",', '  "ts": 1', "}", None]
    df = frame(spark, {"f": lines})
    doc = spark.createDataFrame([("f", "log")], "file string, kind string")
    got = found(entries(df, doc))
    assert got == {("f", 1, 4, "store", 30), ("f", 5, 6, None, 0), ("f", 7, 7, "store", 50), ("f", 9, 12, "c", 50)} or got == {("f", 1, 4, "store", 30), ("f", 5, 6, "", 0), ("f", 7, 7, "store", 50), ("f", 9, 12, "c", 50)}


def test_nulls_and_empty(spark):
    df = frame(spark, {"f": [None, "", "x"]}).unionByName(spark.createDataFrame([(None, None, None, None), ("f", None, None, "[2026-03-01 10:00:02] [error] [store] b")], "file string, host string, line_no long, text string"))
    df = df.withColumn("h", F.lit("clash")).withColumn("kind", F.lit(1))
    doc = spark.createDataFrame([("f", "log"), (None, "log")], "file string, kind string")
    assert entries(df, doc).count() == 0
    assert entries(df.limit(0), doc.limit(0)).count() == 0
    assert BLOCK > 1


def test_level_rank():
    assert [level_rank(x) for x in ("err", "SEVERE", "F", "<131", "<134", "50", "notice", None, "", "odd")] == [50, 50, 60, 50, 30, 50, 30, 0, 0, 0]


def full(spark, lines, block=BLOCK):
    doc = spark.createDataFrame([("f", "log")], "file string, kind string")
    rows = entries(frame(spark, {"f": lines}), doc, block=block).collect()
    return {r["first_line"]: (r["last_line"], r["ts_raw"], r["lvl"], r["component"], r["msg"]) for r in rows}


def test_zone_abbreviation_weekday_year_and_bare_values(spark):
    lines = [f"2026-02-08 10:23:{i:02d},865 AEDT ERROR store.a - flush {i} lost" for i in range(40)]
    lines += [f"Thu Mar 12 04:16:{i:02d} 2026 [error] [core] lost {i}" for i in range(40)]
    lines += [f"level=error component=cache ts=2026-03-01T10:00:{i:02d}Z msg=flushed-{i}" for i in range(40)]
    lines += [f"01-Mar-2026 10:00:{i:02d} PM ERROR net - odd hour {i}" for i in range(3)]
    got = full(spark, lines)
    assert [got[i + 121][1:] for i in range(3)] == [(f"01-Mar-2026 10:00:{i:02d} PM", "ERROR", "net", f"odd hour {i}") for i in range(3)]
    for i in range(40):
        assert got[i + 1] == (i + 1, f"2026-02-08 10:23:{i:02d},865 AEDT", "ERROR", "store.a", f"flush {i} lost")
        assert got[i + 41] == (i + 41, f"Thu Mar 12 04:16:{i:02d} 2026", "error", "core", f"lost {i}")
        assert got[i + 81] == (i + 81, f"2026-03-01T10:00:{i:02d}Z", "error", "cache", f"flushed-{i}")


@pytest.mark.parametrize("block", [3, 10, BLOCK])
def test_objects_in_an_indented_array_and_their_fields(spark, block):
    lines = ["["]
    for i in range(30):
        lines += ["  {", f'    "time": "2026-03-01 10:00:{i:02d}",', '    "logger": "net",', '    "inner": [', "      1,", '      {"time": 5, "level": "error", "logger": "x"}', "    ],", '    "level":', '    "level": "error",', f'    "msg": "a {{b}} \\"{i}\\""', "  },"]
    lines += ["]", "2026-03-01 10:10:00 ERROR store - after"] + [f"2026-03-01 10:11:{i:02d} ERROR store - after" for i in range(9)]
    got = full(spark, lines, block)
    want = {2 + 11 * i: (1 + 11 * (i + 1), f"2026-03-01 10:00:{i:02d}", "error", "net", f'a {{b}} "{i}"') for i in range(30)}
    want[2 + 11 * 29] = (332, *want[2 + 11 * 29][1:])
    assert {k: v for k, v in got.items() if k <= 332} == want
    assert got[333] == (333, "2026-03-01 10:10:00", "ERROR", "store", "after")


@pytest.mark.parametrize("n", [3, 8, 40])
def test_heads_of_any_length(spark, n):
    """A level behind any number of words or signs, if it differs from line to line; a constant one far in a line is no level."""
    words = " ".join(f"part{'abcdefghij'[i % 10]}" for i in range(n))
    lines = [f"2026-03-01 10:00:{i:02d} {words} {LEVELS[i % 5]} said {i}" for i in range(50)]
    signs = "|".join(str(i) for i in range(n))
    lines += [f"2026-03-01 11:00:{i:02d}|{signs}|{LEVELS[i % 5]}|net|said {i}" for i in range(50)]
    lines += [f"2026-03-01 12:00:{i:02d} one two three four five of ERROR kind" for i in range(20)]
    got = full(spark, lines)
    for i in range(50):
        assert got[i + 1][1:3] == (f"2026-03-01 10:00:{i:02d}", LEVELS[i % 5])
        assert got[i + 51][1:] == (f"2026-03-01 11:00:{i:02d}", LEVELS[i % 5], "net", f"said {i}")
    assert max(got) == 100


def test_templates_have_slots(spark):
    from tidemark.operators import iplom

    lines = [f"[2026-03-01 10:00:{i:02d}] [ERROR] [net] flush of {i} took {'abcdefg'[i % 7]} ms" for i in range(50)]
    got = {r["template"]: (r["slots"], r["cnt"]) for r in iplom.written(iplom.templates(iplom.counted(frame(spark, {"f": lines})))).collect()}
    assert sum(c for _, c in got.values()) == 70  # with the 20 repeated rows of the fixture
    assert all(t.startswith("[ <T> ] [ <L> ] [ net ] flush of <N> took") for t in got)
