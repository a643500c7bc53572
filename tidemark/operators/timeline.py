"""Several logs as one timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from ..functions.timestamps import PREFIX, prefix_seconds
from .parse import parse_auto


def merged(*sources: DataFrame, parsed: bool = True, scan: int | None = None) -> DataFrame:
    """``file, line, ts_raw, ts, text`` of all lines of all sources, with ``scan`` of the first so many lines of each file. With ``parsed`` the time comes from the record; lines that
    are no record fall back to a timestamp at their start."""
    both = reduce(DataFrame.unionByName, [s.select("file", "line", "text") for s in sources])
    if scan is not None:
        both = both.where(F.col("line") <= scan)
    t = present(F.col("text"))
    raw = F.regexp_extract(t, PREFIX, 0)
    plain = F.struct(F.when(raw != "", raw).alias("ts_raw"), prefix_seconds(t).alias("ts"))
    if not parsed:
        return both.select("file", "line", plain["ts_raw"].alias("ts_raw"), plain["ts"].alias("ts"), "text")
    # a generator, not a projection: each line is parsed once
    rec = both.select("*", F.explode(F.array(parse_auto(t))).alias("__r"))
    pick = lambda c: F.when(F.col("__r").isNotNull(), F.col("__r")[c]).otherwise(plain[c])
    return rec.select("file", "line", pick("ts_raw").alias("ts_raw"), pick("ts").alias("ts"), "text")


def ordered(rows: DataFrame) -> DataFrame:
    """Dated rows by time, file and line, then undated ones by file and line. A range-partitioned sort: any size."""
    return rows.orderBy(F.asc_nulls_last("ts"), "file", "line")


def exported(rows: DataFrame) -> DataFrame:
    """``time | file:line | text`` of every row of a timeline, in order."""
    stamp = F.when(present(F.col("ts_raw")) == "", "-").otherwise(F.col("ts_raw"))
    return ordered(rows).select(F.concat(stamp, F.lit(" | "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(" | "), present(F.col("text"))).alias("value"))
