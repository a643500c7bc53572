"""Drift of files and of parser versions."""

import random

import pytest

from tidemark.operators.schema_drift import consistent, file_changes, groups, parser_changes, pattern_changes, unified

SCHEMA = "series string, file_seq int, file string, line long, time string, level string, msg string, fields map<string,string>"


def rows_of(series, seq, n, make, rng):
    out = []
    for i in range(n):
        t, lvl, msg = f"2026-01-{seq:02d} 10:{i % 60:02d}:00", rng.choice(["INFO", "WARN"]), f"job {rng.randrange(1000)} done"
        out.append((series, seq, f"{series}/{seq}", i, t, lvl, msg, make(t, lvl, msg, i)))
    return out


def changes(spark, rows):
    return {tuple(r) for r in file_changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_all_kinds_of_change(spark):
    rng = random.Random(1)
    num, sess = (lambda: str(rng.randrange(1000, 9000))), (lambda: f"S-{rng.randrange(16**5):05x}")
    rows = rows_of("s", 1, 100, lambda t, lv, m, i: {"ts": t, "level": lv, "msg": m, "took": num(), "session": sess(), "gone": rng.choice(["x", "yy"])} | ({"stray": "1"} if i < 5 else {}), rng)
    rows += rows_of("s", 2, 100, lambda t, lv, m, i: {"time": t, "severity": lv, "msg": m, "elapsed": num(), "session": sess(), "load": f"0.{rng.randrange(100, 999)}"}, rng)
    rows += rows_of("s", 3, 100, lambda t, lv, m, i: {"time": str(1767225600 + i), "severity": lv, "msg": m, "elapsed": num() + "ms", "session": "-" if i < 30 else sess(), "load": f"0.{rng.randrange(100, 999)}"}, rng)
    rows += rows[:50]  # repeated rows
    assert changes(spark, rows) == {("s", 2, "ts", "renamed"), ("s", 2, "level", "renamed"), ("s", 2, "took", "renamed"), ("s", 2, "gone", "removed"), ("s", 2, "load", "added"), ("s", 3, "elapsed", "retyped")}


def test_another_range_is_no_rename(spark):
    rng = random.Random(2)
    rows = rows_of("s", 1, 80, lambda t, lv, m, i: {"time": t, "size": str(rng.randrange(10**8, 10**9))}, rng)
    rows += rows_of("s", 2, 80, lambda t, lv, m, i: {"time": t, "status": rng.choice(["200", "404"])}, rng)
    assert changes(spark, rows) == {("s", 2, "size", "removed"), ("s", 2, "status", "added")}


def test_share_of_records_counts_repeated_rows_once(spark):
    rows = [("s", 1, "a", i, None, None, None, {"x": "1"} | ({"rare": "1"} if i < 1 else {})) for i in range(11)]
    rows += [rows[0]] * 5  # copies do not lift the rare field over the limit
    rows += [("s", 2, "b", i, None, None, None, {"x": "1"}) for i in range(11)]
    assert changes(spark, rows) == set()


def test_nulls_and_empty(spark):
    rows = [(None, 1, "a", 1, None, None, None, {"x": "1"}), ("s", None, "a", 2, None, None, None, {"x": "1"}), ("s", 1, None, None, None, None, None, None), ("s", 2, "b", 1, "t", None, None, {"x": None})]
    assert changes(spark, rows) == {("s", 2, "x", "added")}
    assert file_changes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "pattern,want",
    [
        (r"{TS} {LVL} {MSG}", ["ts", "level", "msg"]),
        (r"(?P<a>\d{2,3}) x{2} {b} {c:[\w-]+{1,2}}", ["a", "b", "c"]),
        (r"\{no} (?:x) (?<d>(a|b)\)) {e:\{}", ["d"]),
        (None, []),
        ("", []),
    ],
)
def test_groups(pattern, want):
    assert [n for n, _ in groups(pattern)][: len(want)] == want


def test_pattern_styles_are_no_change_and_places_matter():
    a = groups(r"{TS} {code:\d+} {thread} {MSG}")
    assert pattern_changes(a, groups(r"{TS},\s*(?P<code>\d+),\s*(?P<thread>\S+),\s*(?P<msg>.*)")) == []
    assert pattern_changes(a, groups(r"{TS} {err:\d+} {thread} {MSG}")) == [("code", "renamed")]
    assert sorted(pattern_changes(a, groups(r"{TS} {thread} {err:\d+} {MSG}"))) == [("code", "removed"), ("err", "added")]
    assert pattern_changes(a, groups(r"{TS} {code:\S+} {thread} {MSG}")) == [("code", "retyped")]


def test_parser_versions(spark):
    rows = [("p", 1, "{TS} {a} {MSG}"), ("p", 2, "{TS} {b} {MSG}"), ("p", 2, "{TS} {b} {MSG}"), ("p", 3, "{TS} {b} {c:x} {MSG}"), ("q", 1, None), (None, 1, "{a}"), ("q", 2, "{a}")]
    df = spark.createDataFrame(rows, "name string, version int, pattern string")
    assert {tuple(r) for r in parser_changes(df).collect()} == {("p", 2, "a", "renamed"), ("p", 3, "c", "added"), ("q", 2, "a", "added")}


def test_unified_reports_failed_casts(spark):
    rows = [("s", 1, "a", i, None, None, None, {"n": str(i)}) for i in range(30)] + [("s", 2, "b", 1, None, None, None, {"n": "12ms"}), ("s", 2, "b", 2, None, None, None, {"n": ""})]
    got = unified(spark.createDataFrame(rows, SCHEMA)).where("file = 'b'").collect()
    assert {(r["line"], r["as_long"], r["as_text"], r["failed"]) for r in got} <= {(1, None, "12ms", True), (2, None, "", False), (1, None, "12ms", False)}


def test_consistent_table_follows_renames(spark):
    rng = random.Random(3)
    num = lambda: str(rng.randrange(1000, 9000))
    rows = rows_of("s", 1, 40, lambda t, lv, m, i: {"ts": t, "took": num(), "up": "true"}, rng)
    rows += rows_of("s", 2, 40, lambda t, lv, m, i: {"time": t, "elapsed": num() if i else "12ms", "up": "false"} | ({"stray": "1"} if i == 1 else {}), rng)
    rows += rows_of("s", 3, 40, lambda t, lv, m, i: {"time": t, "cost": num(), "up": "-"} if i else None, rng)
    rows += [("s", 3, "s/3", 99, None, None, None, {}), (None, None, "x", 1, "t", None, None, {"k": "v"})]
    df = spark.createDataFrame(rows + rows[:30], SCHEMA)
    got = {(r["file"], r["line"]): r for r in consistent(df).collect()}
    assert len(got) == len(rows) == consistent(df).count()
    types = dict(consistent(df).select("values.*").dtypes)
    assert types == {"ts": "string", "took": "bigint", "up": "boolean"}
    for series, seq, file, line, t, lvl, msg, fields in rows:
        r, f = got[file, line], fields or {}
        assert (r["series"], r["file_seq"], r["time"], r["level"], r["msg"]) == (series, seq, t, lvl, msg)
        v = next((f[k] for k in ("took", "elapsed", "cost") if k in f), None)
        assert r["values"]["took"] == (int(v) if v and v != "12ms" else None)
        assert r["values"]["up"] == {"true": True, "false": False}.get(f.get("up"))
    assert got["s/2", 0]["failed"] == {"took": "12ms"} and got["s/2", 1]["other"] == {"stray": "1"} and got["x", 1]["other"] == {"k": "v"}
    long = unified(df).where("field = 'took' or field is null").collect()
    assert sum(r["field"] == "took" for r in long) == 119 and sum(r["field"] is None for r in long) == 2
    assert consistent(df.limit(0)).count() == 0
