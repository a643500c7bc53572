"""Session-level helpers shared by every operator: sessions, table access, size-checked joins, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the optimiser's size estimate is at most this many bytes.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: Copies of each right-hand row in a salted join; a hot key is spread over as many tasks.
SALTS = 16


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE with skew handling, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_LIMIT, salt_by: Column | None = None) -> DataFrame:
    """Join a large table with a smaller one on ``keys`` without trusting that the smaller one is small.

    Up to ``limit`` estimated bytes the lookup is broadcast, so the large side is not shuffled at all.
    Beyond it both sides are shuffled on the keys plus a salt, so that a key which holds a large
    part of the facts is spread over SALTS tasks. ``how`` is ``left``, ``inner`` or ``left_semi``/``left_anti``.
    """
    if estimated_bytes(lookup) <= limit:
        return facts.join(F.broadcast(lookup), keys, how)
    salt = "__salt"
    by = salt_by if salt_by is not None else F.monotonically_increasing_id()
    left = facts.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only on a local master, as in tests, one is made if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        where = _own_dir[0]
    return where


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends there and survives lost executors.

    The table stays until ``drop_cuts`` or the end of the program, as frames that were made from it may read it at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts() -> None:
    """Remove all tables written by ``cut``; to be called when the results of the queries so far have been written."""
    while _cuts:
        _drop(*reversed(_cuts.popitem()))


_cuts: dict[str, SparkSession] = {}
atexit.register(drop_cuts)


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs started within carry a tag, by which ``cancel`` ends them."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the running jobs of a tag; the action that waits for them raises an error."""
    spark.sparkContext.cancelJobsWithTag(tag)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)
