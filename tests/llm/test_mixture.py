"""Mixtures: shares, caps, reproducibility."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixture import mixture, plan, shares, sized, thresholds, truncated_mean


@pytest.mark.parametrize("cap", [1, 2, 5])
@pytest.mark.parametrize("mean", [0.1, 0.5, 0.9, 1.7, 4.4])
def test_thresholds_have_the_mean(mean, cap):
    t = thresholds(mean, cap)
    assert len(t) == cap and t == sorted(t)
    got = sum(1 - x for x in t)
    assert math.isclose(got, min(mean, cap), rel_tol=1e-6)
    if mean < cap:
        assert t[0] > 0


def test_truncated_mean_and_plan():
    assert math.isclose(truncated_mean(0.3, 50), 0.3, rel_tol=1e-9) and thresholds(1.0, 0) == [] and thresholds(0, 3) == []
    p = plan({"a": 100, "b": 100}, [("a", 1.0, 5), ("b", 3.0, 1), ("c", 1.0, 2), (None, 1.0, 1), ("d", None, None)])
    assert p["c"] == [] and p["d"] == [] and len(p["a"]) == 5 and p["b"] == [0.0]


def test_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, "one two three four five", "a" if i < 3000 else "b") for i in range(4000)] + [(9000, None, "a"), (9001, "", "a"), (9002, "x", None), (9003, "x", "unknown"), (0, "one two three four five", "a")], "doc_id long, text string, source string").withColumn("copies", F.lit("clash")).withColumn("steps", F.lit(1))
    w = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 4), ("none", 0.1, 3), ("a", 0.4, 2)], "source string, target_share double, max_repeat int")
    m = mixture(docs, w)
    got = {r["source"]: r for r in shares(m, w, sized(docs)).collect()}
    assert abs(got["a"]["actual_share"] - 0.4) < 0.03 and abs(got["b"]["actual_share"] - 0.6) < 0.03 and got["none"]["actual_share"] == 0
    assert got["a"]["most_copies"] <= 2 and got["b"]["most_copies"] <= 4 and {r["doc_id"] for r in m.collect()} <= set(range(4000))
    assert [got[s]["reachable"] for s in ("a", "b", "none")] == [True, True, False]
    assert sum(r["renormalised_share"] for r in got.values()) == pytest.approx(1, abs=1e-5) and got["a"]["renormalised_share"] == pytest.approx(0.4, abs=1e-6)
    assert all(r["text"] == "one two three four five" for r in m.collect())
    short = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 1)], "source string, target_share double, max_repeat int")
    less = {r["source"]: r for r in shares(mixture(docs, short), short, sized(docs)).collect()}
    assert not less["b"]["reachable"] and less["b"]["n_documents"] == 1000 and less["b"]["renormalised_share"] == less["b"]["actual_share"] and less["a"]["reachable"]
    again = mixture(docs.repartition(7), w)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))
    assert mixture(docs.limit(0), w).count() == 0 and mixture(docs, w.limit(0)).count() == 0
