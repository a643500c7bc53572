"""Frequent values against exact counts; the sketch's guarantee; bounded work on hot values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.heavy_hitters import Sketch, candidates, heavy, top


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    s, truth = Sketch(3, 64), Counter()
    for _ in range(30):
        h = rng.choice(10**6, 50, replace=False).astype(np.int64) * 7919
        h[:5] = np.arange(5)
        h = np.unique(h)
        n = rng.integers(1, 9, len(h))
        truth.update(dict(zip(h.tolist(), n.tolist())))
        est = s.add(h, n)
        assert (est >= [truth[x] for x in h.tolist()]).all()


def frame(spark):
    rng = random.Random(2)
    rows = [("hot", 7)] * 3000 + [("few rows", 9000)] + [(f"rare {rng.randrange(10**6)}", rng.randrange(1, 4)) for _ in range(6000)] + [("Hot", 1), ("", 10**6), (None, 10**6), ("zero", 0), ("none", None), ("tie a", 500), ("tie b", 500)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "label string, count long").withColumn("hash", F.lit("clash")).withColumn("n", F.lit("clash"))


def test_heavy_and_top(spark):
    rows, df = frame(spark)
    exact = Counter()
    for k, v in rows:
        if k and v:
            exact[k] += v
    total = sum(exact.values())
    for share in (0.2, 0.05, 0.005):
        assert {r["label"]: r["count"] for r in heavy(df, share).collect()} == {k: v for k, v in exact.items() if v >= share * total}
        assert {r["label"] for r in heavy(df, share, exact=False).collect()} >= {k for k, v in exact.items() if v >= share * total}
    assert all(r["proven"] for r in top(df, 4).collect()) and not any(r["proven"] for r in top(df, 4, exact=False).collect())
    got = [(r["label"], r["count"]) for r in top(df, 4).collect()]
    assert got == [(r["label"], r["count"]) for r in top(df, 4, exact=False).collect()]
    assert got == [("hot", 21000), ("few rows", 9000), ("tie a", 500), ("tie b", 500)]


def test_rows_count_without_a_count_column(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)], "label string")
    assert [(r["label"], r["count"]) for r in heavy(df, 0.5, count=None).collect()] == [("a", 5)]
    assert heavy(df.limit(0), 0.5, count=None).count() == 0 and top(df.limit(0), 3, count=None).count() == 0
    with pytest.raises(ValueError):
        heavy(df, 1e-9)


def test_hot_values_leave_a_partition_once(spark):
    df = spark.range(0, 50000, 1, 4).select(F.lit("hot").alias("label"), F.lit(1).alias("count"))
    totals = candidates(df).where("label is null").agg(F.sum("estimate").alias("n")).first()["n"]
    assert totals == 50000


def test_recall_and_error_of_the_estimates(spark):
    """Of the true top 100 among 300 000 values, the sketch alone finds at least 90, and the recount all that it proves."""
    from tidemark.llm.heavy_hitters import DEPTH, WIDTH

    df = spark.range(0, 1_000_000, 1, 8).select(F.concat(F.lit("v"), F.floor(300_000 * F.pow(F.rand(3), 3)).cast("string")).alias("label"), F.lit(1).alias("count"))
    true = {r["label"]: r["count"] for r in df.groupBy("label").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "label").limit(100).collect()}
    alone = {r["label"]: r["count"] for r in top(df, 100, exact=False).collect()}
    recounted = {r["label"]: (r["count"], r["proven"]) for r in top(df, 100).collect()}
    assert len(alone.keys() & true.keys()) >= 90 and {k: v for k, (v, p) in recounted.items() if p}.items() <= true.items()
    assert all(alone[k] >= true[k] for k in alone.keys() & true.keys())
    assert sum(alone[k] - true[k] > 2.72 * 1_000_000 / WIDTH for k in alone.keys() & true.keys()) <= 100 * 2.72**-DEPTH + 5
