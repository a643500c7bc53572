"""Problem 4: most frequent values of a column of any length with bounded memory.

1. Each input partition pre-aggregates its rows in Arrow (flushed at FLUSH distinct values), so a value that holds a
   third of the rows leaves a partition a handful of times.
2. The partial counts are hash-partitioned by value. Each partition feeds a count-min sketch with conservative update
   and keeps the HEAP values with the highest estimates; a value lives in one partition, so the heaps are disjoint.
3. The union of the heaps holds every value whose share is at least ``share``; estimates never fall below true counts.

Memory a task: DEPTH x WIDTH longs, one heap, one batch - whatever the number of rows or of distinct values.

Defined results: null and empty values and null counts are left out; negative counts are not allowed for and count as 0;
values are compared byte by byte; ties are ordered by value; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join, table

DEPTH, WIDTH = 4, 1 << 17
#: candidates a partition keeps: at most 1/share values can reach a share of the whole, so this holds them for shares down to 1/HEAP several times over
HEAP = 2048
FLUSH = 1 << 17
_PARTIAL = "label string, hash long, n long"


_KIND = pa.schema([("label", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])


def _pre_aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = kept = 0

    def grouped() -> pa.Table:
        return pa.concat_tables(held).group_by(["label", "hash"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["label", "hash", "n"]).cast(_KIND)

    for batch in batches:
        held.append(pa.Table.from_arrays(batch.columns, schema=_KIND))
        rows += batch.num_rows
        if rows > max(FLUSH, 2 * kept):  # rows wait until grouping them is worth it
            held = [grouped()]
            rows = kept = len(held[0])
            if kept > FLUSH:
                yield from held[0].combine_chunks().to_batches()
                held, rows, kept = [], 0, 0
    if held:
        yield from grouped().combine_chunks().to_batches()


class Sketch:
    """Count-min sketch with conservative update; a batch updates in one vectorised step. A value's estimate never falls below its true count."""

    def __init__(self, depth: int = DEPTH, width: int = WIDTH) -> None:
        self.depth, self.width = depth, width
        self.cells = np.zeros((depth, width), np.int64)

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b + np.uint64(i * i)) % np.uint64(self.width)).astype(np.int64) for i in range(self.depth)])

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add distinct values' counts; returns their estimates after it."""
        at = self._at(hashes)
        now = np.min([self.cells[i, at[i]] for i in range(self.depth)], axis=0) + counts
        for i in range(self.depth):
            np.maximum.at(self.cells[i], at[i], now)
        return now


def _sketch(heap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, best, total = Sketch(), {}, 0
        floor = 0
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(["label", "hash"], use_threads=False).aggregate([("n", "sum")])
            hashes, counts = t["hash"].to_numpy(), t["n_sum"].to_numpy()
            total += int(counts.sum())
            now = sketch.add(hashes, counts)
            hot = np.flatnonzero(now >= floor)
            for label, est in zip(t["label"].take(pa.array(hot)).to_pylist(), now[hot].tolist()):
                best[label] = est
            if len(best) > 2 * heap:
                kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:heap]
                best, floor = dict(kept), kept[-1][1]
        kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:heap]
        # no value that was left out has an estimate above the least one kept
        least = kept[-1][1] if len(kept) == heap else 0
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept] + [None], pa.string()), pa.array([v for _, v in kept] + [total], pa.int64()), pa.array([None] * len(kept) + [least], pa.int64())], ["label", "estimate", "least"])

    return run


def candidates(items: DataFrame, value: str = "label", count: str | None = "count", heap: int = HEAP) -> DataFrame:
    """``label, estimate`` of the values with the highest estimates of every partition, and rows without a label that hold the
    partitions' totals and ``least``, the bound for the estimate, and so for the count, of every value left out."""
    n = F.greatest(F.col(count).cast("long"), F.lit(0)) if count else F.lit(1).cast("long")
    rows = items.select(F.col(value).cast("string").alias("label"), n.alias("n")).where("label is not null and label <> '' and n is not null")
    partial = rows.select("label", F.xxhash64("label").alias("hash"), "n").mapInArrow(_pre_aggregate, _PARTIAL)
    return partial.repartition("hash").mapInArrow(_sketch(heap), "label string, estimate long, least long")


def _recounted(items: DataFrame, few: DataFrame, value: str, count: str | None) -> DataFrame:
    """``label, count``: the exact counts of some values, as many as the heaps hold at most."""
    n = F.greatest(F.col(count).cast("long"), F.lit(0)) if count else F.lit(1).cast("long")
    rows = items.select(F.col(value).cast("string").alias("label"), n.alias("n")).where("label is not null and label <> ''")
    return lookup_join(rows, few.select("label"), ["label"], "left_semi").groupBy("label").agg(F.sum("n").alias("count"))


def heavy(items: DataFrame, share: float, value: str = "label", count: str | None = "count", exact: bool = True) -> DataFrame:
    """``label, estimate, count`` of the values with at least ``share`` of the summed count.

    At most 1/share values qualify and the heaps hold more, so none is missed; with ``exact`` the few candidates are
    counted again (``count``), which removes those the sketch overestimates; without it ``count`` is the estimate. An
    estimate exceeds the count by at most e/WIDTH of its partition's total with a probability of 1 - exp(-DEPTH).
    """
    if share * HEAP < 1:
        raise ValueError(f"a share below 1/{HEAP} needs a larger heap")
    found = cut(candidates(items, value, count))
    total = found.where("label is null").agg(F.sum("estimate").alias("total"))
    top = found.where("label is not null").crossJoin(F.broadcast(total)).where(F.col("estimate") >= share * F.col("total"))  # one row: the total
    if not exact:
        return top.select("label", "estimate", F.col("estimate").alias("count"))
    few = cut(top)
    again = lookup_join(few, cut(_recounted(items, few, value, count)), ["label"], "inner")
    return again.where(F.col("count") >= share * F.col("total")).select("label", "estimate", "count")


def top(items: DataFrame, k: int, value: str = "label", count: str | None = "count", exact: bool = True) -> DataFrame:
    """The ``k`` values with the highest counts (``label, count, proven``), ties by value.

    The candidates of all partitions are counted again; a count above ``least`` of every partition is ``proven``: no value
    left out can reach it. Without ``exact`` counts are estimates, never below the true ones, and nothing is proven.
    """
    if k > HEAP:
        raise ValueError(f"at most {HEAP} values")
    found = cut(candidates(items, value, count))
    few = found.where("label is not null")
    if not exact:
        return few.select("label", F.col("estimate").alias("count"), F.lit(False).alias("proven")).orderBy(F.desc("count"), "label").limit(k)
    bound = found.agg(F.coalesce(F.max("least"), F.lit(0)).alias("bound"))
    again = _recounted(items, few, value, count).orderBy(F.desc("count"), "label").limit(k)
    return again.crossJoin(F.broadcast(bound)).select("label", "count", (F.col("count") > F.col("bound")).alias("proven")).orderBy(F.desc("count"), "label")  # one row: the bound


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label`` of at least 0.5 % of the summed count."""
    return heavy(table(spark, sf_dir, "top_item"), 0.005).select("label")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 labels with the highest counts."""
    return top(table(spark, sf_dir, "top_item"), 100)
