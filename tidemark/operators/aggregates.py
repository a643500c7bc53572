"""Aggregations over lines: top error signatures and sessions, errors per minute, severity density, coverage, text counts.

All counts are exact; ``step`` reads every step-th line instead where a sample is wanted. Ties are ordered by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from ..functions.timestamps import prefix_seconds
from ..runtime import lookup_join
from ..sources.lines import with_bytes

# Error words by priority; the error and warning marks of the density map.
ERROR_WORDS = ["ERROR", "EXCEPTION", "FATAL"]
ERROR_MARKS, WARN_MARKS = ["ERROR", "FATAL", "Exception"], ["WARN"]


def signature(text: Column) -> Column:
    """From the first error word (in order of priority, any ASCII case) on, the first ten words; null without one."""
    t = present(text)
    at = F.coalesce(*[F.nullif(F.instr(F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), w), F.lit(0)) for w in ERROR_WORDS])
    words = F.filter(F.split(F.substr(t, at), r"\s+"), lambda w: w != "")
    return F.when(at.isNotNull(), F.array_join(F.slice(words, 1, 10), " "))


def first_bracket(text: Column) -> Column:
    """Content of the first ``[...]`` if it has 3 to 40 bytes, else null."""
    inside = F.regexp_extract(present(text), r"^[^\[]*\[([^\]]*)\]", 1)
    return F.when(F.octet_length(inside).between(3, 40), inside)


def top(lines: DataFrame, label: Column, n: int, step: int = 1) -> DataFrame:
    """``label, count`` of the ``n`` most frequent labels."""
    src = lines if step <= 1 else lines.where((F.col("line") - 1) % step == 0)
    return src.select(label.alias("label")).where("label is not null and label <> ''").groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label").limit(n)


def top_errors(lines: DataFrame, n: int = 20, step: int = 1) -> DataFrame:
    return top(lines, signature(F.col("text")), n, step)


def top_sessions(lines: DataFrame, n: int = 20, step: int = 1) -> DataFrame:
    return top(lines, first_bracket(F.col("text")), n, step)


def _marked(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | present(text).contains(w)
    return out


def error_histogram(lines: DataFrame, bins: int = 1024) -> DataFrame:
    """``file, bin, start_min, count, first_line``: error lines of each file per time bin, all bins of the file's span; no
    rows for a file with fewer than two dated error lines or all in one minute. Lines are counted per file and minute
    first, so only minutes meet the spans."""
    at = prefix_seconds(F.ltrim(present(F.col("text"))))
    minutes = lines.where(_marked(F.col("text"), ERROR_MARKS)).select("file", F.floor(at / 60).cast("long").alias("m"), "line").where("m is not null")
    per = minutes.groupBy("file", "m").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))
    span = per.groupBy("file").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.sum("n").alias("total")).where("hi > lo and total >= 2")
    size = F.col("hi") - F.col("lo") + 1
    span = span.select("file", "lo", "hi", F.ceil(size / F.least(size, F.lit(bins))).cast("long").alias("step"))
    n_bins = F.ceil((F.col("hi") - F.col("lo") + 1) / F.col("step")).cast("int")
    every = span.select("file", "lo", "step", F.explode(F.sequence(F.lit(0), n_bins - 1)).alias("bin"))  # at most ``bins`` rows a file
    placed = lookup_join(per, span, ["file"], "inner", salt_by=F.col("m"))
    counted = placed.select("file", F.floor((F.col("m") - F.col("lo")) / F.col("step")).cast("int").alias("bin"), "n", "first_line").groupBy("file", "bin").agg(F.sum("n").alias("count"), F.min("first_line").alias("first_line"))
    return every.join(counted, ["file", "bin"], "left").select("file", "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("start_min"), F.coalesce("count", F.lit(0)).alias("count"), "first_line")


def density(lines: DataFrame, buckets: int = 512) -> DataFrame:
    """``file, bucket, has_error, has_warn``: which parts of a file, by bytes, hold error and warning lines. Without a column
    ``byte`` the lines are placed as if all ended in one ``\\n``; only sizes and flags are shuffled for that, no text."""
    size = (F.octet_length(present(F.col("text"))) + 1).cast("long")
    narrow = lines.select("file", "line", *(["byte"] if "byte" in lines.columns else []), size.alias("size"), _marked(F.col("text"), ERROR_MARKS).alias("e"), _marked(F.col("text"), WARN_MARKS).alias("w"))
    placed = narrow if "byte" in lines.columns else with_bytes(narrow)
    total = placed.groupBy("file").agg(F.max(F.col("byte") + F.col("size")).alias("total"))
    b = F.least(F.floor(F.col("byte") * buckets / F.col("total")), F.lit(buckets - 1)).cast("int")
    flagged = lookup_join(placed.where("e or w"), total, ["file"], "inner", salt_by=F.col("line"))
    return flagged.select("file", b.alias("bucket"), "e", "w").groupBy("file", "bucket").agg(F.bool_or("e").alias("has_error"), F.bool_or("w").alias("has_warn"))


def text_stats(text: Column) -> Column:
    """``chars, words, lines`` of a text."""
    t = present(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    n = F.when(t == "", 0).otherwise(breaks + F.when(t.endswith("\n"), 0).otherwise(1))
    return F.struct(F.length(t).alias("chars"), words.alias("words"), n.alias("lines"))


def coverage(records: DataFrame) -> DataFrame:
    """``file, lines, dated, min_ts, max_ts, min_raw, max_raw`` of every file of records with ``ts`` and ``ts_raw``."""
    return records.groupBy("file").agg(
        F.count("*").alias("lines"),
        F.count("ts").alias("dated"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.min(F.when(F.col("ts").isNotNull(), F.struct("ts", "ts_raw")))["ts_raw"].alias("min_raw"),
        F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", "ts_raw")))["ts_raw"].alias("max_raw"),
    )


def skew(covered: DataFrame) -> DataFrame:
    """One row about the dated files: ``files, overlap_s`` (negative: the gap between disjoint spans), ``start_spread_s``, ``disjoint``, ``zone_hint``."""
    dated = covered.where("min_ts is not null")
    c = dated.agg(F.count("*").alias("files"), (F.min("max_ts") - F.max("min_ts")).alias("overlap_s"), (F.max("min_ts") - F.min("min_ts")).alias("start_spread_s"))
    several = F.col("files") >= 2
    return c.select("files", F.when(several, F.col("overlap_s")).alias("overlap_s"), F.when(several, F.col("start_spread_s")).alias("start_spread_s"), F.coalesce(several & (F.col("overlap_s") < 0), F.lit(False)).alias("disjoint"), F.coalesce(several & (F.col("start_spread_s") > 3600), F.lit(False)).alias("zone_hint"))


def skew_report(covered: DataFrame) -> DataFrame:
    """The same as lines of text, one per file and one verdict."""
    per = covered.select(F.col("file").alias("k"), F.format_string("%s: %d lines, %d dated%s", "file", "lines", "dated", F.when(F.col("dated") > 0, F.concat(F.lit(", "), "min_raw", F.lit(" ... "), "max_raw")).otherwise("")).alias("report"))
    v = skew(covered)
    text = (
        F.when(F.col("files") == 0, "no dated file: sorted by file and line")
        .when(F.col("files") == 1, "only one dated file")
        .when(F.col("disjoint"), F.format_string("WARNING: the time spans do not overlap (gap %d s)", -F.col("overlap_s")))
        .otherwise(F.format_string("all files overlap for %d s", F.col("overlap_s")))
    )
    hint = F.when(F.col("zone_hint"), F.format_string("; starts are %d s apart, perhaps another time zone", F.col("start_spread_s"))).otherwise("")
    return per.unionByName(v.select(F.lit(None).cast("string").alias("k"), F.concat(text, hint).alias("report"))).orderBy(F.asc_nulls_last("k")).select("report")
