"""Joins with and without broadcast, lineage cuts."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark import runtime


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_either_way(spark, how):
    facts = spark.createDataFrame([(None if i == 3 else f"k{i % 5}" if i % 2 else "hot", i) for i in range(200)], "k string, i long")
    lookup = runtime.cut(spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3), (None, 4)], "k string, v int"))
    a = runtime.lookup_join(facts, lookup, ["k"], how, salt_by=F.col("i"))
    b = runtime.lookup_join(facts, lookup, ["k"], how, limit=0, salt_by=F.col("i"))
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert "Broadcast" in a._jdf.queryExecution().toString() and "__salt" in b._jdf.queryExecution().toString()


def test_cut_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", None)], "a int, b string, c array<string>")
    got = runtime.cut(df)
    assert got.schema == df.schema and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert got.inputFiles() and all("cut-" in f for f in got.inputFiles())
    assert runtime.estimated_bytes(df) > 0 and os.path.isdir(runtime.shared_dir(spark).removeprefix("file://"))
    assert runtime.cut(df.limit(0)).count() == 0


def test_tagged_jobs_can_be_cancelled(spark):
    import threading
    import time

    def stop():
        time.sleep(3)
        runtime.cancel(spark, "slow")

    t = threading.Thread(target=stop)
    t.start()
    with pytest.raises(Exception, match="(?i)cancel"), runtime.tagged(spark, "slow"):
        spark.range(0, 8, 1, 8).selectExpr("reflect('java.lang.Thread', 'sleep', 20000L)").collect()
    t.join()
    assert spark.range(3).count() == 3


def test_cuts_are_dropped(spark):
    got = runtime.cut(spark.range(5))
    path = got.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    runtime.drop_cuts()
    assert not os.path.exists(path) and not runtime._cuts
