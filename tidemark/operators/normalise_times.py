"""Problem 2: normalise the stated times of record tables and find stored ``ts`` that contradict them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import with_instant
from ..runtime import lookup_join, table

#: table -> column that states the time
STATED = {"merged_row": "ts_raw", "parsed_record": "ts_raw", "json_summary": "time"}


def normalised(records: DataFrame, doc: DataFrame, text: str) -> DataFrame:
    """``file, line, stated, ts, micros, seconds``: the instant of each record's stated time.

    ``records`` needs file, line, ts and the column ``text``; ``doc`` needs file, tz_name, mtime and one row a
    file (repeated rows are removed). Nulls in any column, files missing in ``doc`` (UTC, no default year) and
    empty tables are allowed; further columns are ignored. Repeated records stay repeated.
    """
    zones = doc.where(F.col("file").isNotNull()).groupBy("file").agg(F.first("tz_name", True).alias("tz_name"), F.first(F.year("mtime"), True).alias("year"))
    slim = records.select("file", "line", F.col(text).alias("stated"), "ts")
    joined = lookup_join(slim, zones, ["file"], "left", salt_by=F.col("line"))
    done = with_instant(joined, "stated")
    return done.select("file", "line", "stated", "ts", "micros", F.floor(F.col("micros") / 1_000_000).cast("long").alias("seconds"))


def p2_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, file, line, stated, micros``: every record's instant (null if none is stated)."""
    doc = table(spark, sf_dir, "doc")
    parts = [normalised(table(spark, sf_dir, t), doc, c).select(F.lit(t).alias("tbl"), "file", "line", "stated", "micros") for t, c in STATED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tbl, file, line`` of records whose ``ts`` is not the stated instant in whole seconds."""
    doc = table(spark, sf_dir, "doc")
    out = None
    for t, c in STATED.items():
        rows = table(spark, sf_dir, t).where(F.col("ts").isNotNull() & F.col(c).isNotNull())
        bad = normalised(rows, doc, c).where(F.col("seconds") != F.col("ts")).select(F.lit(t).alias("tbl"), "file", "line")
        out = bad if out is None else out.unionByName(bad)
    return out.distinct()
