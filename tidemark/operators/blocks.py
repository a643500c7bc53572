"""Blocks of related lines around a line: SQL statements, transactions, checkpoints.

From a line upwards, whichever comes first decides the block's start: a start mark (that line), or an end mark above the
line (the next line). Downwards the first end mark closes it. In window form both are running extremes, so the blocks of
all lines of all files come out at once; frames are bounded by ``reach`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present

REACH = {"sql": 5000, "transaction": 100_000, "checkpoint": 100_000}


def marks(kind: str, text: Column) -> tuple[Column, Column]:
    """Conditions for start and end marks."""
    t = F.ltrim(present(text))
    up = F.upper(F.trim(F.regexp_replace(present(text), r"\s+$", "")))
    go = up == "GO"
    if kind == "sql":
        return t.startswith("--INSERT-") | t.startswith("INSERT INTO"), go
    if kind == "transaction":
        return up.startswith("BEGIN TRANSACTION") | up.startswith("--BEGIN TRANSACTION"), up.startswith("COMMIT WORK") | up.startswith("ROLLBACK WORK") | go
    if kind == "checkpoint":
        return up.startswith("--START CHECKPOINT"), up.startswith("--FINISH CHECKPOINT")
    raise ValueError(f"no blocks of kind {kind!r}")


def bounds(lines: DataFrame, kind: str, reach: int | None = None) -> DataFrame:
    """``file, line, block_start, block_end`` (null where a mark is missing within reach).

    Only marks and line numbers are shuffled, no text. A file is cut into pieces of eight times the reach; each piece also
    sees the marks of ``reach`` lines of its neighbours, so a file of any length is spread over many tasks and every line
    still sees its whole frame.
    """
    n = reach or REACH[kind]
    size = 8 * n
    own = F.floor(F.col("line") / size).cast("long")
    pieces = F.array_distinct(F.array(F.floor((F.col("line") - n) / size).cast("long"), own, F.floor((F.col("line") + n) / size).cast("long")))
    start, end = marks(kind, F.col("text"))
    l = F.col("line")  # noqa: E741
    marked = lines.select("file", "line", F.when(start, l).alias("__s"), F.when(end, l).alias("__e"), own.alias("__own"))
    # lines without a mark are needed in their own piece only
    marked = marked.withColumn("__piece", F.explode(F.when(F.col("__s").isNotNull() | F.col("__e").isNotNull(), pieces).otherwise(F.array(own))))
    # running extremes in both directions: the nearest marks, which then must lie within reach
    by = Window.partitionBy("file", "__piece").orderBy("line")
    back = Window.partitionBy("file", "__piece").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    near = marked.withColumns({"__s": F.max("__s").over(by.rowsBetween(Window.unboundedPreceding, 0)), "__p": F.max("__e").over(by.rowsBetween(Window.unboundedPreceding, -1)), "__e": F.min("__e").over(back)})
    within = lambda c: F.when(F.abs(F.col(c) - l) <= n, F.col(c))
    out = near.where("__own = __piece").withColumns({"block_start": F.greatest(within("__s"), within("__p") + 1), "block_end": within("__e")})
    return out.select("file", "line", "block_start", "block_end")


def block_of(lines: DataFrame, kind: str, file: str, line: int) -> DataFrame:
    """Lines of the block around one line."""
    n = REACH[kind]
    near = lines.where((F.col("file") == file) & F.col("line").between(line - n, line + n))
    at = bounds(near, kind).where(F.col("line") == line).select("file", F.col("block_start").alias("__a"), F.col("block_end").alias("__b"))
    return near.join(F.broadcast(at), "file").where(F.col("line").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")  # one row


def all_blocks(lines: DataFrame, kind: str) -> DataFrame:
    """``file, block_start, block_end, lines``: every block with both marks."""
    b = bounds(lines, kind).where("block_start is not null and block_end is not null")
    return b.groupBy("file", "block_start", "block_end").agg(F.count("*").alias("lines"))
