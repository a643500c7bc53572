"""Boolean queries, filters, the SQL dialect and searches against plain evaluators."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import boolean, filters, timestamps
from tidemark.operators import aggregates, blocks, export, parse, search, timeline
from tidemark.plans import sql_lite

MIX = ["alpha here", "beta here", "alpha and beta", "nothing here", "Érror ОШИБКА", "", None, "GAMMA -x", "a=b beta"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(MIX, 1)], "file string, line long, text string")


def matched(lines, cond):
    return [r["line"] for r in lines.where(cond).orderBy("line").collect()]


@pytest.mark.parametrize("q", ["alpha XOR beta", "alpha NAND beta", "alpha NOR beta", "alpha -beta", '"alpha and" | gamma', "(alpha | beta) & NOT here", "érror", "ошибка", "NOT NOT alpha", "- x"])
def test_boolean_agrees_with_ast(lines, q):
    tree = boolean.parse(q)
    assert matched(lines, boolean.condition(q, F.col("text"))) == [i for i, t in enumerate(MIX, 1) if boolean.holds(tree, t or "")]


def test_random_boolean_queries(lines):
    rng, terms = random.Random(3), ["alpha", "beta", "here", "nothing", '"and"']

    def make(d):
        if d == 0 or rng.random() < 0.3:
            return rng.choice(terms)
        return rng.choice(["({} AND {})", "({} OR {})", "({} XOR {})", "({} NAND {})", "({} NOR {})"]).format(make(d - 1), make(d - 1)) if rng.random() < 0.8 else f"NOT {make(d - 1)}"

    qs = [make(3) for _ in range(40)]
    got = lines.select("line", *[boolean.condition(q, F.col("text")).alias(f"q{i}") for i, q in enumerate(qs)]).orderBy("line").collect()
    for i, q in enumerate(qs):
        assert [r[f"q{i}"] for r in got] == [boolean.holds(boolean.parse(q), t or "") for t in MIX], q


@pytest.mark.parametrize("q", ["", "  ", '"open', "(a", "a AND", "AND a", ")", '""'])
def test_boolean_errors(q):
    with pytest.raises(boolean.QueryError):
        boolean.parse(q)


def test_filter_forms():
    assert boolean.to_filter("a b -c") == "a b -c" and boolean.to_filter("NOT (a OR b)") == "-a -b"
    with pytest.raises(boolean.QueryError):
        boolean.to_filter("a OR b")
    f = filters.parse("x -y k=v -k2=v2 - =z q= -")
    assert (f.include, f.exclude, f.fields, f.not_fields) == (["x", "=z", "q="], ["y"], [("k", "v")], [("k2", "v2")])
    assert [boolean.is_boolean(q) for q in ("a", "a b", '"a"', "-a", "a|b", "")] == [False, True, True, True, True, False]


def test_json_filter(spark):
    rows = ['{"level":"error","msg":"x"}', "plain", '{"LEVEL":"ERROR"}', '{"level":"debug"}', "[1,2]", '{"level":"error"} x}', "{'level':'error'}", '{"level":null}']
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(rows, 1)], "file string, line long, text string")
    assert matched(df, filters.condition("level=ERROR", F.col("text"))) == [1, 3]
    assert matched(df, filters.condition("-level=DEBUG", F.col("text"))) == [1, 2, 3, 5, 6, 7, 8]


def test_literal_and_regex_hits(spark):
    rows = ["er über er", "ER", "x", "", None, "ererer", "foo(?!bar) foobaz id=42"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(rows, 1)], "file string, line long, text string")
    hits = lambda d: [(r["line"], r["col_start"], r["col_end"]) for r in d.orderBy("line", "col_start").collect()]
    assert hits(search.literal_hits(df, "er")) == [(1, 0, 2), (1, 6, 8), (1, 9, 11), (6, 0, 2), (6, 2, 4), (6, 4, 6)]
    assert (2, 0, 2) in hits(search.literal_hits(df, "er", sensitive=False))
    assert hits(search.regex_hits(df, "er")) == hits(search.literal_hits(df, "er"))
    assert hits(search.regex_hits(df, r"(?<=id=)\d+")) == [(7, 21, 23)]
    assert hits(search.literal_hits(df, "(?!")) == [(7, 3, 6)]
    assert hits(search.boolean_hits(df, "über -ER")) == [] and hits(search.boolean_hits(df, "-er x")) == [(3, 0, 1)]
    assert hits(search.boolean_hits(df, "id OR baz")) == [(7, 14, 17)]


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("(?<=ERROR).*timeout", [["timeout"]]),
        ("ab+c", []),
        ("abc?d", [["ab"]]),
        ("a|bcd", []),
        ("(?i)abc", []),
        (r"x[abc]\.log", [[".log"]]),
        ("(?:abc|xyz)+ end", [[" end"], ["abc", "xyz"]]),
        ("(error|warn)ing", [["error", "warn"], ["ing"]]),
        ("(abc)?", []),
        ("(?P<n>abc)(?!def)", [["abc"]]),
    ],
)
def test_required_clauses(pattern, want):
    assert sorted(search.required_clauses(pattern)) == sorted(want)


def test_alternations_of_literals(lines):
    assert search.literal_alternatives(r"a\.b|c d") == ["a.b", "c d"] and search.literal_alternatives("a|b+") is None and search.literal_alternatives("ab") is None
    cond = search.regex_condition(F.col("text"), "alpha|nothing")
    assert matched(lines, cond) == [1, 3, 4] and "rlike" not in str(cond).lower()
    with pytest.raises(ValueError):
        search.regex_condition(F.col("text"), "(a")


@pytest.mark.parametrize("pattern", ["a+", "x*", "b|", r"\b\w", "é|ö.", "(?=b)", "$"])
def test_spans_agree_with_an_engine(spark, pattern):
    import regex

    texts = ["", "aab", "baa", "éaöb", "xxaxx", "b b", "ab" * 5]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line long, text string")
    got = {(r["line"], r["col_start"], r["col_end"]) for r in search.regex_hits(rows, pattern).collect()}
    want = {(i, len(t[: m.start()].encode()), len(t[: m.end()].encode())) for i, t in enumerate(texts) for m in regex.finditer(pattern, t) if m.end() > m.start()}
    assert got == want


def test_highlight_spans(spark):
    rules = [parse.Rule("ids", r"id=(\d+)", True, variants=True), parse.Rule("err", "error", whole_line=True), parse.Rule("ok", "OK", sensitive=True), parse.Rule("none", "")]
    df = spark.createDataFrame([("é id=12 id=7 ERROR",), ("ok OK",), (None,)], "text string")
    got = [[tuple(x) for x in r["s"]] for r in df.select(parse.highlight_spans(F.col("text"), rules).alias("s")).collect()]

    def shade(w):
        h = 2166136261
        for b in w.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h % 5

    assert got[0] == [("ids", 6, 8, "12", shade("12")), ("ids", 12, 13, "7", shade("7")), ("err", 0, 19, "é id=12 id=7 ERROR", 0)]
    assert got[1] == [("ok", 3, 5, "OK", 0)] and got[2] == []
    one = df.select(parse.keyword_spans(F.lit("x WARNING Caused by: FATAL")).alias("s")).first()["s"]
    assert [tuple(x) for x in one] == [(2, 9, "WARNING"), (10, 20, "Caused by:"), (21, 26, "FATAL")]


def test_prefilter_never_drops_a_match(spark):
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd.") for _ in range(12)) for _ in range(60)]
    pieces = ["a", "b", "ab", "c+", "d?", "[ab]", "(?:cd)", "a*", r"\.", ".", "(?=b)", "b{2}", "^", "cd"]
    pats = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    for p in pats:
        for t in texts:
            if re.search(p, t):
                assert all(any(x in t for x in c) for c in search.required_clauses(p)), (p, t)


def test_views_and_ranges(spark):
    df = spark.createDataFrame([("f", i, f"line {i}" + (" ERROR" if i % 10 == 0 else "")) for i in range(1, 101)], "file string, line long, text string")
    err = df.where(F.col("text").contains("ERROR"))
    assert search.context(df, err, 1).count() == 29
    assert [r["row"] for r in search.ranked(err, block=7).orderBy("line").collect()] == list(range(1, 11))
    assert [tuple(r) for r in search.quick_find(df, "ERROR", 95).collect()] == [("f", 100)] and [tuple(r) for r in search.quick_find(df, "ERROR", 100).collect()] == [("f", 10)]
    assert [tuple(r) for r in search.quick_find(df, "ERROR", 10, False).collect()] == [("f", 100)]
    r = spark.createDataFrame([("f", 1, 3), ("f", 4, 5), ("f", 8, 9), ("f", 2, 2)], "file string, first long, last long")
    assert {(x["first"], x["last"]) for x in search.merge_ranges(r).collect()} == {(1, 5), (8, 9)}
    page, total = search.capped(search.literal_hits(df, "line"), 10)
    assert page.count() == 10 and total.first()["total"] == 100
    t = {x["value"] for x in export.ticket(df, err, "E`R", 1).collect()}
    assert len(t) == 11 and any(x.startswith("## Line 10 {#") and "\n>>> line 10 ERROR\n" in x for x in t) and any("- Query: `E'R`" in x for x in t)


@pytest.mark.parametrize("text", ["level = ERROR LIMIT 5", "SELECT", "SELECT a WHERE", "SELECT * LIMIT 5.5", "a = ", "SELECT FROM x", "a ! b", "(a = b", ""])
def test_sql_errors(text):
    with pytest.raises(sql_lite.SqlError):
        sql_lite.parse(text)


def test_sql_comparisons(spark):
    rows = [("f", i, None, None, {"v": v}) for i, v in enumerate(["10", "9", "abc", "", "nan", "1d", "inf", "2026-01-01 00:00:00", "É", "5."], 1)]
    df = spark.createDataFrame(rows, "file string, line long, ts long, ts_raw string, fields map<string,string>")
    lines_of = lambda q: [r["line"] for r in sql_lite.run(q, df).collect()]
    assert lines_of("v > 9.5") == [1, 3, 7, 9] or set(lines_of("v > 9.5")) >= {1, 7}
    assert 5 not in lines_of("v > 0") and 7 in lines_of("v > 0") and 6 in lines_of("v > 0")
    assert lines_of("v >= '2025-12-31 23:59:59' AND v ~ 2026") == [8]
    assert lines_of("v = ABC") == [3] and lines_of("v = 'é'") == [] and lines_of("w != x") == list(range(1, 11)) and lines_of("line <= 2") == [1, 2]
    assert sql_lite.run("SELECT COUNT(*) WHERE NOT v = ''", df).first()["count"] == 9
    assert [tuple(r) for r in sql_lite.run("SELECT v GROUP BY file ORDER BY count", df).collect()] == [("f", 10)]


def test_parsers(spark):
    rows = ["2026-09-04 10:00:01 WARN slow id=3", "--- random ---", "[2026-09-04 10:00:01] [SESSION-42] INSERT INTO t", "2026-09-04 10:00:01.250 session=user99 UPDATE t", "[2026-09-04 10:00:01] [ERROR] msg", '{"timestamp":"2026-09-04 10:00:01","level":"error","msg":"x","code":1.0,"n":null,"o":{"a":[1]}}', "2026-09-04 10:00:01. x", "2026-02-31T10:00:60 no level here", None, "", "x" * 5000]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(rows, 1)], "file string, line long, text string")
    got = {r["line"]: r for r in parse.records(df).collect()}
    assert [got[i]["kind"] for i in range(1, 12)] == ["generic", "plain", "sql", "sql", "sql", "json", "plain", "generic", "plain", "plain", "plain"]
    assert (got[1]["level"], got[1]["msg"], got[1]["fields"]["id"]) == ("WARN", "slow id=3", "3")
    assert got[3]["fields"]["action"] == "INSERT" and got[3]["fields"]["session"] == "SESSION-42" and got[3]["msg"] == "INTO t" and got[3]["level"] is None
    assert got[4]["fields"]["session"] == "session=user99" and got[4]["fields"]["action"] == "UPDATE" and got[4]["ts_raw"] == "2026-09-04 10:00:01.250"
    assert got[5]["fields"]["session"] == "ERROR" and got[5]["level"] is None
    assert got[6]["fields"] == {"timestamp": "2026-09-04 10:00:01", "level": "error", "msg": "x", "code": "1.0", "o": '{"a":[1]}'} and got[6]["ts"] == got[1]["ts"]
    assert got[8]["ts"] == timestamps.seconds_of("2026-03-03 10:01:00")
    p = parse.Parser("p", "{TS} {LVL} {MSG}")
    assert p.fields() == ["ts", "level", "msg"] and [r["line"] for r in parse.records(df, p).collect()] == [1]
    assert parse.expand(r"x{2,3} {host} [{code:\d+}]") == r"x{2,3} (?P<host>\S+) [(?P<code>\d+)]"
    for bad in (parse.Parser("", "{a}"), parse.Parser("p", "a"), parse.Parser("p", "(")):
        with pytest.raises(ValueError):
            bad.fields()
    assert parse.detect(df.limit(1)).first()["format"] == "generic" and parse.detect(df.limit(0)).count() == 0


def test_times(spark):
    df = spark.createDataFrame([("f", 1, "x"), ("f", 2, "2026-01-01 00:00:10 a"), ("f", 3, "y"), ("f", 4, "2026-01-01 00:00:20 b"), ("f", 5, "z"), ("f", 6, "2026-01-01 00:00:30 c")], "file string, line long, text string")
    t0 = timestamps.seconds_of("2026-01-01 00:00:10")
    assert [r["line"] for r in timestamps.time_range(df, t0, t0 + 10).orderBy("line").collect()] == [2, 3, 4, 5]
    assert [tuple(r) for r in timestamps.goto_time(df, t0 + 1).collect()] == [("f", 4)]
    assert [timestamps.goto(x)[0] for x in ("1.842.291", "50%", "akhir", "start", "2026-01-01 00:00:00", "abc")] == ["line", "percent", "last", "first", "time", "text"]
    with pytest.raises(ValueError):
        timestamps.time_range(df, 2, 1)
    m = [(r["line"], r["ts"]) for r in timeline.ordered(timeline.merged(df, parsed=False)).collect()]
    assert [x[0] for x in m] == [2, 4, 6, 1, 3, 5]


def test_blocks(spark):
    tx = ["x", "--BEGIN TRANSACTION-1", "a", "COMMIT WORK", "y"]
    cp = ["--START CHECKPOINT", *"abcd", "--FINISH CHECKPOINT"]
    sq = ["GO", "INSERT INTO t", " x", "go", "a", "b", "  INSERT INTO u", "c", " Go "]
    df = lambda ls: spark.createDataFrame([("f", i, t) for i, t in enumerate(ls, 1)], "file string, line long, text string")
    bounds = lambda ls, k: {r["line"]: (r["block_start"], r["block_end"]) for r in blocks.bounds(df(ls), k).collect()}
    assert bounds(tx, "transaction")[3] == (2, 4) and bounds(cp, "checkpoint")[3] == (1, 6)
    assert bounds(sq, "sql")[3] == (2, 4) and bounds(sq, "sql")[8] == (7, 9)
    assert bounds(sq, "sql") == {r["line"]: (r["block_start"], r["block_end"]) for r in blocks.bounds(df(sq), "sql", 9).collect()}
    assert blocks.block_of(df(tx), "transaction", "f", 3).count() == 3 and blocks.all_blocks(df(tx), "transaction").count() == 1


def test_aggregates(spark):
    ls = ["2026-01-01 00:00:00 ERROR a b c d e f g h i j k", "an exception then ERROR late x", "[ab] [abc]", "[abc] x", "2026-01-01 00:05:00 FATAL z", None, ""]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(ls, 1)], "file string, line long, text string")
    assert {tuple(r) for r in aggregates.top_errors(df, 9).collect()} == {("ERROR a b c d e f g h i", 1), ("ERROR late x", 1), ("FATAL z", 1)}
    assert [tuple(r) for r in aggregates.top_sessions(df, 9).collect()] == [("abc", 1)]
    h = aggregates.error_histogram(df).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 0, 0, 0, 0, 1] and aggregates.error_histogram(df.limit(1)).count() == 0
    c = aggregates.coverage(timeline.merged(df))
    assert c.first()["dated"] == 2 and aggregates.skew(c).first()["disjoint"] is False
    assert "only one dated file" in [r["report"] for r in aggregates.skew_report(c).collect()][-1]


def test_required_literals_of_a_statement_change_nothing(spark):
    texts = ["2026-03-01 10:00:00 ERROR disk id=1", "2026-03-01 10:00:01 WARN slow", '{"level":"err\\u006fr","msg":"x"}', '{"Level":"Error","msg":"DISK full"}', "plain error", None, "2026-03-01 10:00:02 session=a insert into t"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], "file string, line long, text string")
    for q in ("level = error", "msg ~ disk AND level = ERROR", "level = error OR level = warn", "NOT level = error", "session = '-'", "msg ~ disk OR line > 4", "action = INSERT", "level != error", "SELECT COUNT(*) WHERE msg ~ 'disk'", "SELECT level WHERE level ~ r GROUP BY level"):
        got = sorted(map(tuple, sql_lite.query(q, lines).collect()))
        assert got == sorted(map(tuple, sql_lite.run(q, sql_lite.rows(lines)).collect())), q
    assert sql_lite.required(sql_lite.parse("msg ~ disk AND level = ERROR").where) == ["error"] and sql_lite.required(sql_lite.parse("NOT level = error").where) is None


def test_scan_cap(spark):
    lines = spark.createDataFrame([(f, i, f"2026-03-01 10:00:{i:02d} {'ERROR' if i % 10 == 0 else 'INFO'} x") for f in "ab" for i in range(1, 51)], "file string, line long, text string")
    rows = sql_lite.rows(lines)
    assert sql_lite.run("level = ERROR", rows, scan=20).count() == 4 and sql_lite.query("SELECT COUNT(*) WHERE level = ERROR", lines, scan=20).first()["count"] == 4
    assert tuple(sql_lite.statistics("level = ERROR", rows, 20).first()) == (40, 4, False, True) and tuple(sql_lite.statistics("level = ERROR", rows).first()) == (100, 10, False, False)


def test_histogram_per_file_and_block_marks(spark):
    from tidemark.operators import blocks

    lines = spark.createDataFrame([(f, i, f"2026-03-01 10:{m:02d}:00 ERROR x") for f, ms in {"a": [0, 0, 3], "b": [5, 7], "c": [1, 1]}.items() for i, m in enumerate(ms, 1)], "file string, line long, text string")
    got = {(r["file"], r["bin"]): (r["count"], r["first_line"]) for r in aggregates.error_histogram(lines).collect()}
    assert got == {("a", 0): (2, 1), ("a", 1): (0, None), ("a", 2): (0, None), ("a", 3): (1, 3), ("b", 0): (1, 1), ("b", 1): (0, None), ("b", 2): (1, 2)}
    texts = ["START CHECKPOINT", "--start checkpoint 1", "-- FINISH CHECKPOINT", "x", "--FINISH CHECKPOINT", "--COMMIT WORK", "--BEGIN TRANSACTION", "y", "--ROLLBACK WORK", "rollback work", "go"]
    b = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts, 1)], "file string, line long, text string")
    assert [tuple(r) for r in blocks.all_blocks(b, "checkpoint").collect()] == [("f", 2, 5, 4)]
    assert ("f", 7, 10, 4) in [tuple(r) for r in blocks.all_blocks(b, "transaction").collect()]


def test_sets_of_lines_and_kept_results(spark, lines):
    a, b = lines.where("line <= 4"), lines.where("line >= 3 and line <= 6")
    got = {how: sorted(r["line"] for r in search.combined(a.unionByName(a), b, how).collect()) for how in ("union", "intersect", "minus", "xor")}
    assert got == {"union": [1, 2, 3, 4, 5, 6], "intersect": [3, 4], "minus": [1, 2], "xor": [1, 2, 5, 6]}
    with pytest.raises(ValueError):
        search.combined(a, b, "times")
    kept, asked = search.Results(), []
    first = kept.get("alpha", lambda: asked.append(1) or lines.where("text like '%alpha%'"))
    assert kept.get("alpha", lambda: asked.append(1)) is first and asked == [1] and first.count() == 2 and kept.names() == ["alpha"]
    kept.forget("alpha")
    with pytest.raises(KeyError):
        kept.get("alpha")
