"""Following a growing log: a streaming source whose offset is a file's identity and position.

An offset holds generation, byte, next line and the file's size, head and tail fingerprints. A file that grew under the same
head has been appended to; one that shrank, or whose head or tail changed, was replaced: a new generation starts at line 1.
A last line without an end is held back until it gets one, so every line is delivered once and whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions.scalars import fnv1a

HEAD, TAIL = 64 * 1024, 16 * 1024
SCHEMA = "file string, generation int, line bigint, byte bigint, text string"
#: bytes read for one batch at most
BATCH = 64 * 1024 * 1024


def identity(path: str, at: int | None = None) -> dict:
    """Size and fingerprints of a file, or of its first ``at`` bytes."""
    size = os.path.getsize(path) if at is None else at
    with open(path, "rb") as f:
        head = f.read(min(HEAD, size))
        tail = b""
        if size > HEAD:
            f.seek(size - TAIL)
            tail = f.read(TAIL)
    return {"size": size, "head": f"{fnv1a(head):016x}:{len(head)}", "tail": f"{fnv1a(tail):016x}" if tail else None}


def decide(before: dict, path: str) -> str:
    """``unchanged``, ``appended`` or ``replaced``: what happened to a file since its identity was taken."""
    size = os.path.getsize(path)
    if size < before["size"]:
        return "replaced"
    then = identity(path, before["size"])
    same = then["head"] == before["head"] and then["tail"] == before["tail"]
    if not same:
        return "replaced"
    return "unchanged" if size == before["size"] else "appended"


class FollowReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"generation": 0, "byte": 0, "line": 1, "size": 0, "head": f"{fnv1a(b''):016x}:0", "tail": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not os.path.exists(self.path):
            return iter([]), start
        at = dict(start)
        if decide(start, self.path) == "replaced":
            at = self.initialOffset() | {"generation": start["generation"] + 1}
        rows, end = self._lines(at, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The lines between two offsets once more, after a failure."""
        at = dict(start)
        if end["generation"] != start["generation"]:
            at = self.initialOffset() | {"generation": end["generation"]}
        return iter(self._lines(at, end["byte"])[0])

    def _lines(self, at: dict, stop: int | None) -> tuple[list[tuple], dict]:
        with open(self.path, "rb") as f:
            f.seek(at["byte"])
            data = f.read(BATCH if stop is None else stop - at["byte"])
            if stop is None and len(data) == BATCH and b"\n" not in data:
                data += f.readline()  # a line longer than a batch is read to its end
        whole = data[: data.rfind(b"\n") + 1]
        rows, byte, line = [], at["byte"], at["line"]
        for raw in whole.split(b"\n")[:-1]:
            text = raw.removesuffix(b"\r").decode("utf-8", "replace")
            rows.append((self.path, at["generation"], line, byte, text.removeprefix("\ufeff") if byte == 0 else text))
            byte, line = byte + len(raw) + 1, line + 1
        return rows, at | {"byte": byte, "line": line} | identity(self.path, byte)


class FollowSource(DataSource):
    """Format ``tidemark_follow``; option ``path``: the file."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_follow"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return FollowReader(self.options["path"])


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of a growing file; filters, searches and parsers apply to it as to any lines."""
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("tidemark_follow").option("path", path).load()


def searched(stream: DataFrame, query: str, regex: bool = False, sensitive: bool = False) -> DataFrame:
    """The lines of a followed file that match a query, as they come: only new lines are searched."""
    from pyspark.sql import functions as F

    from ..operators.search import condition

    return stream.where(condition(F.col("text"), query, regex, sensitive))


def new_lines(batch: DataFrame) -> DataFrame:
    """``generation, lines, last``: how many lines a batch (or table) of a followed file holds, and the number of the last."""
    from pyspark.sql import functions as F

    return batch.groupBy("generation").agg(F.count("*").alias("lines"), F.max("line").alias("last"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Lines per level and time window of lines; on a stream, state of windows older than ``late`` is dropped by the watermark."""
    from pyspark.sql import functions as F

    from ..operators.parse import parse_auto

    rec = stream.select(F.explode(F.array(parse_auto(F.col("text")))).alias("r")).where("r.ts is not null")
    at = rec.select(F.timestamp_seconds(F.col("r.ts")).alias("at"), F.upper(F.coalesce(F.col("r.level"), F.lit("-"))).alias("level"))
    counted = at.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "level").agg(F.count("*").alias("lines"))
    return counted.select(F.col("w.start").alias("start"), "level", "lines")


def run_to_table(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a streaming query over all input that is there now and return its result as a table in the shared folder.

    In ``update`` mode the state of windows behind the watermark is dropped; a row replaces the earlier one of its ``keys``.
    """
    import uuid

    from pyspark.sql import functions as F

    from ..runtime import shared_dir

    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    put = lambda df, i: df.withColumn("__batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, __batch long").parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*stream.columns)
