"""Queries over log lines derived from the tables, each with the same result in SQL.

E: one line per event. J: the same as JSON. T: as SQL trace. D: lines of documents. L: lines of line_view.
Line numbers come from the tables, so nothing is numbered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, scalars, timestamps
from ..operators import aggregates, blocks, export, parse, search, timeline
from ..runtime import table
from ..sources.lines import from_column, line_count
from ..streaming import follow
from . import sql_lite

# ---- lines ----


def _events(spark: SparkSession, d: str, src: DataFrame | None = None) -> DataFrame:
    lvl = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    e = (table(spark, d, "events") if src is None else src).withColumns({"lvl": lvl, "cents": F.round(F.col("value") * 100).cast("bigint"), "at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    return e


def e_lines(spark: SparkSession, d: str, files: int = 1) -> DataFrame:
    file = F.lit("events") if files == 1 else F.concat(F.lit("events"), (F.col("user_id") % files).cast("string"))
    text = F.concat("at", F.lit(" "), "lvl", F.lit(" [user-"), "user_id", F.lit("] "), "event_type", F.lit(" id="), "event_id", F.lit(" cents="), "cents")
    return _events(spark, d).select(file.alias("file"), F.col("event_id").alias("line"), text.alias("text"))


def streamed_lines(spark: SparkSession, d: str) -> DataFrame:
    """E as a stream: the events' file as a streaming source."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    src = reader.parquet(f"{d}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    text = F.concat("at", F.lit(" "), "lvl", F.lit(" "), "event_type")
    return _events(spark, d, src).select(text.alias("text"))


def j_lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"ts":"'), "at", F.lit('","level":"'), "lvl", F.lit('","msg":"'), "event_type", F.lit('","id":'), "event_id", F.lit("}"))
    return _events(spark, d).select(F.lit("events").alias("file"), F.col("event_id").alias("line"), text.alias("text"))


def t_lines(spark: SparkSession, d: str) -> DataFrame:
    verb = F.when(F.col("event_type") == "purchase", "insert").when(F.col("event_type") == "view", "SELECT").otherwise("note")
    text = F.concat(F.lit("["), "at", F.lit("] [SESSION-"), "user_id", F.lit("] "), verb, F.lit(" "), "event_type", F.lit(" id="), "event_id")
    return _events(spark, d).select(F.lit("events").alias("file"), F.col("event_id").alias("line"), text.alias("text"))


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Three files that mix the formats: SQL traces, generic and plain lines; JSON and SQL traces; generic lines."""
    a, b, c = (x(spark, d).select("line", "text") for x in (j_lines, t_lines, e_lines))
    n = F.col("line")
    j = a.where((n % 3 == 1) & (n % 2 == 0))
    # a verb and a session make a trace
    t = b.where((n % 3 == 0) & (n % 5 < 2) | (n % 3 == 1) & (n % 2 != 0))
    g = c.where((n % 3 == 2) | (n % 3 == 0) & (n % 5 == 2)).select("line", F.regexp_replace("text", r" \[user-\d+\]", "").alias("text"))
    p = c.where((n % 3 == 0) & (n % 5 > 2)).select("line", F.concat(F.lit("note "), "line").alias("text"))
    rows = j.unionByName(t).unionByName(g).unionByName(p)
    return rows.select(F.concat(F.lit("mixed"), (F.col("line") % 3).cast("string")).alias("file"), "line", "text")


def d_lines(spark: SparkSession, d: str) -> DataFrame:
    return from_column(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def l_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "line_view").select("file", F.col("line_no").alias("line"), "text").distinct()


def x_lines(spark: SparkSession, d: str) -> DataFrame:
    """Transaction marks by order: every seventh order begins one, every seventh plus three commits it; marks behind dashes or with a blank are none."""
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, F.concat(F.lit("--BEGIN TRANSACTION-"), k)).when(k % 7 == 3, "commit work now").when(k % 7 == 5, "--COMMIT WORK").when(k % 7 == 1, "-- BEGIN TRANSACTION").otherwise(F.concat(F.lit("update order "), k))
    return table(spark, d, "orders").select(F.concat(F.lit("orders"), (F.floor(k / 100_000)).cast("string")).alias("file"), k.alias("line"), text.alias("text")).distinct()


_E = """e AS (SELECT 'events' AS file, event_id AS line, ts, user_id, event_type, event_id, cast(round(value * 100) AS BIGINT) AS cents,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS lvl,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events),
el AS (SELECT *, stamp || ' ' || lvl || ' [user-' || user_id || '] ' || event_type || ' id=' || event_id || ' cents=' || cents AS text,
  '[user-' || user_id || '] ' || event_type || ' id=' || event_id || ' cents=' || cents AS msg FROM e)"""
_D = """d0 AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),
d1 AS (SELECT cast(doc_id AS VARCHAR) AS file, p, generate_subscripts(p, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM d0)),
d AS (SELECT file, cast(line AS BIGINT) AS line, regexp_replace(p[line], '\\r$', '') AS text FROM d1 WHERE NOT (line = len(p) AND p[line] = ''))"""
_L = "l AS (SELECT DISTINCT file, line_no AS line, text FROM line_view)"
_SECONDS = "cast(epoch(date_trunc('second', ts)) AS BIGINT)"


def _sql(statement: str):
    return lambda s, d: sql_lite.query(statement, e_lines(s, d))


def _parsed(lines, *cols: str):
    return lambda s, d: parse.records(lines(s, d)).where("kind <> 'plain'").select("file", "line", *[F.expr(c).alias(c.replace("fields['", "").removesuffix("']")) for c in cols])


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- the SQL dialect ----
_add("sql_count_by_level", _sql("SELECT level FROM log WHERE level = error OR level = WARN GROUP BY level ORDER BY count DESC"), f"WITH {_E} SELECT lvl AS level, count(*) AS \"count\" FROM el WHERE lvl IN ('ERROR', 'WARN') GROUP BY lvl")
_add("sql_count", _sql("SELECT COUNT(*) WHERE msg ~ PURCHASE"), f"WITH {_E} SELECT count(*) AS \"count\" FROM el WHERE event_type = 'purchase'")
_add("sql_where_numeric", _sql("SELECT COUNT(*) WHERE cents > 2500.5 AND cents <= 1e4"), f"WITH {_E} SELECT count(*) AS \"count\" FROM el WHERE cents > 2500.5 AND cents <= 10000")
_add("sql_where_ts_range", _sql("SELECT level FROM log WHERE ts >= '2024-01-05 00:00:00' AND ts < '2024-01-09 12:00:00' GROUP BY level"), f"WITH {_E} SELECT lvl AS level, count(*) AS \"count\" FROM el WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 12:00:00' GROUP BY lvl")
_add("sql_not_paren", _sql("SELECT COUNT(*) WHERE NOT (level = debug OR msg ~ signup) AND cents != 0"), f"WITH {_E} SELECT count(*) AS \"count\" FROM el WHERE lvl <> 'DEBUG' AND event_type <> 'signup' AND cents <> 0")
_add("sql_missing_field", _sql("SELECT COUNT(*) WHERE nothing = '' AND nothing != x"), f'WITH {_E} SELECT count(*) AS "count" FROM el')
_add("sql_group_two_keys", _sql("SELECT level FROM log WHERE cents >= 100 GROUP BY level, id ORDER BY id LIMIT 100000"), f"WITH {_E} SELECT lvl AS level, cast(event_id AS VARCHAR) AS id, count(*) AS \"count\" FROM el WHERE cents >= 100 GROUP BY ALL ORDER BY id, level LIMIT 100000")
_add("sql_select_columns", _sql("SELECT ts, level, id FROM log WHERE level = ERROR LIMIT 100000"), f"WITH {_E} SELECT line, file, stamp AS ts, lvl AS level, cast(event_id AS VARCHAR) AS id FROM el WHERE lvl = 'ERROR' ORDER BY line LIMIT 100000")
_add("sql_shorthand", _sql("level = WARN AND cents > 9000"), f"WITH {_E} SELECT line, file, stamp AS ts, lvl AS level, msg FROM el WHERE lvl = 'WARN' AND cents > 9000 ORDER BY line LIMIT 1000")
_add("sql_statistics", lambda s, d: sql_lite.statistics("level = WARN", sql_lite.rows(e_lines(s, d)), 700), f"WITH {_E} SELECT count(*) FILTER (line <= 700) AS scanned, count(*) FILTER (lvl = 'WARN' AND line <= 700) AS matched, count(*) FILTER (lvl = 'WARN' AND line <= 700) > 1000 AS truncated_rows, count(*) FILTER (line > 700) > 0 AS truncated_scan FROM el")

# ---- search ----
_add("search_literal_ci", lambda s, d: d_lines(s, d).where(search.literal_condition(F.col("text"), "ARCHIVE")).groupBy("file").agg(F.count("*").alias("n")), f"WITH {_D} SELECT file, count(*) AS n FROM d WHERE contains(lower(text), 'archive') GROUP BY file")
_add("search_literal_cs", lambda s, d: l_lines(s, d).where(search.literal_condition(F.col("text"), "ERROR", True)).select("file", "line"), f"WITH {_L} SELECT file, line FROM l WHERE contains(text, 'ERROR')")
_add("search_regex", lambda s, d: l_lines(s, d).where(search.regex_condition(F.col("text"), r"retry [0-9]/[0-9] after timeout on (edge|core)-[0-9]+")).select("file", "line"), f"WITH {_L} SELECT file, line FROM l WHERE regexp_matches(text, 'retry [0-9]/[0-9] after timeout on (edge|core)-[0-9]+')")
_add("search_lookahead", lambda s, d: d_lines(s, d).where(search.regex_condition(F.col("text"), r"archive(?!\.)")).select("file", "line"), f"WITH {_D} SELECT file, line FROM d WHERE regexp_matches(text, 'archive([^.]|$)')")
_add("search_first_position", lambda s, d: search.boolean_hits(l_lines(s, d), "timeout OR segment").select("file", "line", "col_start", "col_end"), f"WITH {_L} SELECT file, line, cast(strlen(left(text, p - 1)) AS INTEGER) AS col_start, cast(strlen(left(text, p - 1)) + 7 AS INTEGER) AS col_end FROM (SELECT *, least(nullif(strpos(lower(text), 'timeout'), 0), nullif(strpos(lower(text), 'segment'), 0)) AS p FROM l) WHERE p IS NOT NULL")
_add("search_occurrences", lambda s, d: d_lines(s, d).select("file", "line", search.match_count(F.col("text"), "er").cast("long").alias("n")).where("n > 0"), f"WITH {_D} SELECT file, line, cast((length(text) - length(replace(text, 'er', ''))) / 2 AS BIGINT) AS n FROM d WHERE contains(text, 'er')")
_add("search_hits", lambda s, d: search.literal_hits(l_lines(s, d), "lag=").select("file", "line", "col_start", "col_end"), f"WITH {_L} SELECT file, line, cast(strlen(split_part(text, 'lag=', 1)) AS INTEGER) AS col_start, cast(strlen(split_part(text, 'lag=', 1)) + 4 AS INTEGER) AS col_end FROM l WHERE contains(text, 'lag=')")
_add("search_regex_hits", lambda s, d: search.regex_hits(l_lines(s, d), r"ms=[0-9.]+").select("file", "line", "col_start", "col_end"), f"WITH {_L} SELECT file, line, cast(strlen(split_part(text, regexp_extract(text, 'ms=[0-9.]+'), 1)) AS INTEGER) AS col_start, cast(strlen(split_part(text, regexp_extract(text, 'ms=[0-9.]+'), 1)) + strlen(regexp_extract(text, 'ms=[0-9.]+')) AS INTEGER) AS col_end FROM l WHERE regexp_matches(text, 'ms=[0-9.]+')")
_add("grep_lines", lambda s, d: search.grep_lines(d_lines(s, d), "the").select("file", "line"), f"WITH {_D} SELECT file, line FROM d WHERE contains(text, 'the')")
_add("search_all_files", lambda s, d: search.search_all(d_lines(s, d), "index"), f"WITH {_D} SELECT file, cast(sum((length(text) - length(replace(text, 'index', ''))) / 5) AS BIGINT) AS hits, false AS truncated FROM d GROUP BY file")
_add("search_scope", lambda s, d: search.scoped(l_lines(s, d), 100, 250).where(search.literal_condition(F.col("text"), "error")).select("file", "line"), f"WITH {_L} SELECT file, line FROM l WHERE line BETWEEN 100 AND 250 AND contains(lower(text), 'error')")
_add("search_page", lambda s, d: search.page(search.literal_hits(l_lines(s, d), "lag="), 50, ("b", 0, 0)).select("file", "line"), f"WITH {_L} SELECT file, line FROM l WHERE contains(text, 'lag=') AND file > 'b' ORDER BY file, line LIMIT 50")
for _n, _q, _c in (
    ("bool_and_not", "segment -error took", "contains(t, 'segment') AND contains(t, 'took') AND NOT contains(t, 'error')"),
    ("bool_xor", "segment XOR lag XOR retry", "(contains(t, 'segment')::INT + contains(t, 'lag')::INT + contains(t, 'retry')::INT) % 2 = 1"),
    ("bool_nand_nor", "(error NAND info) AND (debug NOR trace)", "NOT (contains(t, 'error') AND contains(t, 'info')) AND NOT (contains(t, 'debug') OR contains(t, 'trace'))"),
    ("bool_phrase_or", '"closed by peer" | "cannot read" & archive', "contains(t, 'closed by peer') OR (contains(t, 'cannot read') AND contains(t, 'archive'))"),
):
    _add(_n, lambda s, d, q=_q: l_lines(s, d).where(search.condition(F.col("text"), q)).select("file", "line"), f"WITH {_L} SELECT file, line FROM (SELECT *, coalesce(lower(text), '') AS t FROM l) WHERE {_c}")
_add("filter_tokens", lambda s, d: l_lines(s, d).where(filters.condition("segment -warn took", F.col("text"))).select("file", "line"), f"WITH {_L} SELECT file, line FROM l WHERE contains(lower(text), 'segment') AND contains(lower(text), 'took') AND NOT contains(lower(text), 'warn')")
_add("filter_json_field", lambda s, d: j_lines(s, d).where(filters.condition("LEVEL=error -msg=view", F.col("text"))).select("file", "line"), f"WITH {_E} SELECT file, line FROM el WHERE lvl = 'ERROR' AND event_type <> 'view'")
_add("context_lines", lambda s, d: search.context(e_lines(s, d), e_lines(s, d).where(F.col("text").contains("ERROR")), 1).select("file", "line", "is_hit"), f"WITH {_E}, h AS (SELECT line FROM el WHERE lvl = 'ERROR') SELECT file, line, lvl = 'ERROR' AS is_hit FROM el WHERE line IN (SELECT line - 1 FROM h UNION SELECT line FROM h UNION SELECT line + 1 FROM h)")
_add("view_rank", lambda s, d: search.ranked(l_lines(s, d).where(F.col("text").contains("ERROR"))).select("file", "line", "row"), f"WITH {_L} SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY line) AS row FROM l WHERE contains(text, 'ERROR')")

# ---- parsing ----
_add("parse_generic", _parsed(e_lines, "kind", "ts_raw", "ts", "level", "msg"), f"WITH {_E} SELECT file, line, 'generic' AS kind, stamp AS ts_raw, {_SECONDS} AS ts, lvl AS level, msg FROM el")
_add("parse_kv", _parsed(e_lines, "fields['id']", "fields['cents']"), f"WITH {_E} SELECT file, line, cast(event_id AS VARCHAR) AS id, cast(cents AS VARCHAR) AS cents FROM el")
_add("parse_json", _parsed(j_lines, "kind", "ts_raw", "ts", "level", "msg"), f"WITH {_E} SELECT file, line, 'json' AS kind, stamp AS ts_raw, {_SECONDS} AS ts, lvl AS level, event_type AS msg FROM el")
_add("parse_sqltrace", _parsed(t_lines, "kind", "ts", "msg"), f"WITH {_E} SELECT file, line, 'sql' AS kind, {_SECONDS} AS ts, CASE WHEN event_type IN ('purchase', 'view') THEN '' ELSE 'note ' END || event_type || ' id=' || event_id AS msg FROM el")
_add("parse_custom", lambda s, d: parse.records(e_lines(s, d), parse.Parser("own", r"{TS} {LVL} \[user-{user:\d+}\] (?P<what>\w+) id={num_id:\d+}")).select("line", "level", F.element_at("fields", "user").alias("user"), F.element_at("fields", "what").alias("what"), F.element_at("fields", "num_id").alias("num_id")), f"WITH {_E} SELECT line, lvl AS level, cast(user_id AS VARCHAR) AS user, event_type AS what, cast(event_id AS VARCHAR) AS num_id FROM el")
_add("detect_format", lambda s, d: parse.detect(mixed_lines(s, d)), f"""WITH {_E}, k AS (SELECT 'mixed' || event_id % 3 AS file, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 5 < 2 THEN 's' WHEN event_id % 5 = 2 THEN 'g' ELSE 'p' END WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'j' ELSE 's' END ELSE 'g' END AS k FROM el),
  c AS (SELECT file, count(*) AS n_lines, count(*) FILTER (k = 'j') AS n_json, count(*) FILTER (k = 's') AS n_sql, count(*) FILTER (k = 'g') AS n_generic FROM k GROUP BY file),
  f AS (SELECT *, CASE WHEN n_json * 2 >= n_lines THEN 'json' WHEN n_sql * 2 >= n_lines THEN 'sql' WHEN n_generic * 2 >= n_lines THEN 'generic' ELSE 'plain' END AS format FROM c)
  SELECT file, format, CASE format WHEN 'json' THEN n_json WHEN 'sql' THEN n_sql WHEN 'generic' THEN n_generic ELSE greatest(n_json, n_sql, n_generic) END * 100 // n_lines AS percent, n_lines, n_json, n_sql, n_generic FROM f""")
_add("classify_level", lambda s, d: l_lines(s, d).groupBy(parse.severity(F.col("text")).alias("class")).agg(F.count("*").alias("n")), f"WITH {_L} SELECT CASE WHEN contains(t, 'ERROR') OR contains(t, 'FATAL') OR contains(t, 'Exception') OR contains(t, 'Caused by:') THEN 'error' WHEN contains(t, 'WARN') THEN 'warn' WHEN contains(t, 'INFO') THEN 'info' ELSE 'normal' END AS class, count(*) AS n FROM (SELECT coalesce(text, '') AS t FROM l) GROUP BY 1")
_add("stack_lines", lambda s, d: l_lines(s, d).where(parse.is_stack_line(F.col("text"))).select("file", "line"), f"WITH {_L} SELECT file, line FROM l WHERE regexp_matches(text, '^[ \\t]*(at |\\.\\.\\. )')")

# ---- aggregates ----
_add("top_errors", lambda s, d: aggregates.top_errors(e_lines(s, d), 25), f"WITH {_E} SELECT 'ERROR ' || msg AS label, count(*) AS \"count\" FROM el WHERE lvl = 'ERROR' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
_add("top_sessions", lambda s, d: aggregates.top_sessions(e_lines(s, d), 25), f"WITH {_E} SELECT 'user-' || user_id AS label, count(*) AS \"count\" FROM el GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
_add("error_histogram", lambda s, d: aggregates.error_histogram(e_lines(s, d, 3)), f"""WITH {_E}, m AS (SELECT 'events' || (user_id % 3) AS file, {_SECONDS} // 60 AS m, line FROM el WHERE lvl = 'ERROR'), r AS (SELECT file, min(m) AS lo, max(m) AS hi, max(m) - min(m) + 1 AS span FROM m GROUP BY file),
  s AS (SELECT file, lo, hi, cast(ceil(span / least(span, 1024)) AS BIGINT) AS step FROM r WHERE hi > lo),
  c AS (SELECT file, (m - lo) // step AS bin, count(*) AS n, min(line) AS first_line FROM m JOIN s USING (file) GROUP BY ALL),
  b AS (SELECT file, lo, step, unnest(range(0, cast(ceil((hi - lo + 1) / step) AS BIGINT))) AS bin FROM s)
  SELECT file, cast(bin AS INTEGER) AS bin, lo + bin * step AS start_min, coalesce(n, 0) AS "count", first_line FROM b LEFT JOIN c USING (file, bin)""")
_add("density_map", lambda s, d: aggregates.density(l_lines(s, d)), f"""WITH {_L}, b AS (SELECT *, coalesce(sum(coalesce(strlen(text), 0) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte, sum(coalesce(strlen(text), 0) + 1) OVER (PARTITION BY file) AS total FROM l),
  f AS (SELECT file, cast(least(byte * 512 // total, 511) AS INTEGER) AS bucket, contains(t, 'ERROR') OR contains(t, 'FATAL') OR contains(t, 'Exception') AS e, contains(t, 'WARN') AS w FROM (SELECT *, coalesce(text, '') AS t FROM b))
  SELECT file, bucket, bool_or(e) AS has_error, bool_or(w) AS has_warn FROM f WHERE e OR w GROUP BY ALL""")
_add("timeline_merge", lambda s, d: timeline.ordered(timeline.merged(e_lines(s, d, 3))).select("file", "line", "ts_raw", "ts", "text"), f"WITH {_E} SELECT 'events' || (user_id % 3) AS file, line, stamp AS ts_raw, {_SECONDS} AS ts, text FROM el ORDER BY ts, file, line")
_add("coverage", lambda s, d: aggregates.coverage(timeline.merged(e_lines(s, d, 3))), f"WITH {_E} SELECT 'events' || (user_id % 3) AS file, count(*) AS lines, count(*) AS dated, min({_SECONDS}) AS min_ts, max({_SECONDS}) AS max_ts, min(stamp) AS min_raw, max(stamp) AS max_raw FROM el GROUP BY 1")
_add("skew", lambda s, d: aggregates.skew(aggregates.coverage(timeline.merged(e_lines(s, d, 3)))), f"WITH {_E}, c AS (SELECT user_id % 3 AS f, min({_SECONDS}) AS a, max({_SECONDS}) AS b FROM el GROUP BY 1) SELECT count(*) AS files, min(b) - max(a) AS overlap_s, max(a) - min(a) AS start_spread_s, min(b) < max(a) AS disjoint, max(a) - min(a) > 3600 AS zone_hint FROM c")
_add("time_range", lambda s, d: timestamps.time_range(e_lines(s, d), 1704844800, 1704931200).select("file", "line"), f"WITH {_E}, b AS (SELECT min(line) FILTER ({_SECONDS} >= 1704844800) AS lo, min(line) FILTER ({_SECONDS} > 1704931200) AS hi FROM el) SELECT file, line FROM el, b WHERE line >= lo AND (hi IS NULL OR line < hi)")
_add("goto_timestamp", lambda s, d: timestamps.goto_time(e_lines(s, d, 3), 1705000000), f"WITH {_E} SELECT 'events' || (user_id % 3) AS file, min(line) AS line FROM el WHERE {_SECONDS} >= 1705000000 GROUP BY 1")
_add("blocks_tx", lambda s, d: blocks.all_blocks(x_lines(s, d), "transaction"), """WITH x AS (SELECT DISTINCT 'orders' || (o_orderkey // 100000) AS file, o_orderkey AS line, o_orderkey % 7 AS m FROM orders),
  y AS (SELECT *, greatest(max(CASE WHEN m = 0 THEN line END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING), max(CASE WHEN m = 3 THEN line + 1 END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS block_start,
    min(CASE WHEN m = 3 THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS block_end FROM x)
  SELECT file, block_start, block_end, count(*) AS lines FROM y WHERE block_start IS NOT NULL AND block_end IS NOT NULL GROUP BY ALL""")

# ---- lines, scalars, exports ----
_add("line_count", lambda s, d: line_count(d_lines(s, d)), f"WITH {_D} SELECT file, count(*) AS lines FROM d GROUP BY file")
_add("text_stats", lambda s, d: d_lines(s, d).select("file", "line", aggregates.text_stats(F.col("text")).alias("t")).select("file", "line", "t.chars", "t.words", "t.lines"), f"WITH {_D} SELECT file, line, cast(length(text) AS INTEGER) AS chars, cast(len(regexp_extract_all(text, '[^ \\t\\r\\x0B\\x0C]+')) AS INTEGER) AS words, CASE WHEN text = '' THEN 0 ELSE 1 END AS lines FROM d")
_add("base64_roundtrip", lambda s, d: d_lines(s, d).where("text <> ''").select("file", "line", scalars.base64_text(F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")).alias("text")), f"WITH {_D} SELECT file, line, text FROM d WHERE text <> ''")
_add("format_count", lambda s, d: _events(s, d).select("event_id", scalars.count_text(F.col("event_id") * 12345).alias("shown")), "SELECT event_id, regexp_replace(format('{:,}', event_id * 12345), ',', '.', 'g') AS shown FROM events")
_add("hex_rows", lambda s, d: e_lines(s, d).select("line", F.posexplode(scalars.hex_rows(F.col("text").cast("binary"))).alias("i", "row")), f"""WITH {_E}, p AS (SELECT line, text, unnest(range(0, (length(text) + 15) // 16)) AS i FROM el), q AS (SELECT line, i, substr(text, cast(i * 16 + 1 AS BIGINT), 16) AS t FROM p),
  r AS (SELECT *, lower(hex(encode(t))) AS h FROM q)
  SELECT line, cast(i AS INTEGER) AS i, lpad(lower(hex(i * 16)), 8, '0') || ': ' || rpad(regexp_replace(left(h, 16), '(..)', '\\1 ', 'g'), 24, ' ') || ' ' || rpad(regexp_replace(substr(h, 17, 16), '(..)', '\\1 ', 'g'), 24, ' ') || ' |' || t || '|' AS row FROM r""")
_add("export_csv", lambda s, d: export.csv_rows(l_lines(s, d).where("text is not null").select("line", "text")), f"""WITH {_L} SELECT line || ',' || CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS value FROM l WHERE text IS NOT NULL""")
_add("export_search", lambda s, d: export.matching(e_lines(s, d), "ERROR purchase OR WARN click"), f"WITH {_E} SELECT line || ': ' || text AS value FROM el WHERE lvl = 'WARN'")
_add("export_timeline", lambda s, d: timeline.exported(timeline.merged(e_lines(s, d, 3))), f"WITH {_E} SELECT stamp || ' | events' || (user_id % 3) || ':' || line || ' | ' || text AS value FROM el")
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, strlen(text) + 1), lambda i: cast('0x' || substr(hex(encode(text)), cast(2 * i - 1 AS BIGINT), 2) AS HUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_add("export_ticket", lambda s, d: export.ticket(e_lines(s, d), e_lines(s, d).where(F.col("text").contains("ERROR")), "ERROR", 1), f"""WITH {_E}, h AS (SELECT line AS hit FROM el WHERE lvl = 'ERROR'), o AS (SELECT line, min(hit) AS hit FROM (SELECT hit, unnest([hit - 1, hit, hit + 1]) AS line FROM h) GROUP BY line),
  c AS (SELECT el.line, CASE WHEN lvl = 'ERROR' THEN el.line ELSE hit END AS hit, CASE WHEN lvl = 'ERROR' THEN '>>> ' ELSE '    ' END || text AS shown, text, lvl FROM el JOIN o ON o.line = el.line),
  b AS (SELECT hit, string_agg(shown, chr(10) ORDER BY line) AS body, max(text) FILTER (line = hit) AS text FROM c GROUP BY hit), k AS (SELECT *, {_FNV} AS fnv FROM b)
  SELECT 'events' AS file, '# Log report' || chr(10) || chr(10) || '- File: `events`' || chr(10) || '- Query: `ERROR`' || chr(10) || '- Hits: ' || regexp_replace(format('{{:,}}', count(*)), ',', '.', 'g') || chr(10) || '- Context: +-1 lines' || chr(10) AS value FROM h
  UNION ALL SELECT 'events', '## Line ' || regexp_replace(format('{{:,}}', hit), ',', '.', 'g') || ' {{#' || lpad(lower(hex(cast(xor(fnv // 4294967296, fnv % 4294967296) AS BIGINT))), 8, '0') || '}}' || chr(10) || '```' || chr(10) || body || chr(10) || '```' || chr(10) FROM k""")

_add("stream_windowed_counts", lambda s, d: follow.run_to_table(follow.windowed_counts(streamed_lines(s, d), "1 day", "1 hour"), ["start", "level"]).select(F.unix_timestamp("start").alias("start"), "level", "lines"), f"WITH {_E} SELECT {_SECONDS} // 3600 * 3600 AS start, lvl AS level, count(*) AS lines FROM el GROUP BY ALL")
