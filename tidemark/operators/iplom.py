"""Iterative partitioning of log lines into templates (the layout miner behind problem 1).

Lines are reduced to typed tokens and counted (``line_types``); all further work is on the distinct token sequences.
Three splits - token count and classes of the head, least-variable position, bijection between two positions - give
leaves, whose constant tokens and variable slots are the templates. Every split is a partial aggregation over
(partition, position, token) followed by a size-checked look-up, so a partition that holds a large part of the lines is
neither gathered in one task nor shuffled on its number alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import zone_abbreviations
from ..runtime import cut, lookup_join
from .line_types import M, typed_counts


#: tasks over which the sequences of one first partition are spread
SPREAD = 4


def counted(lines: DataFrame) -> DataFrame:
    """``pid, tokens, head, cnt``: the typed token sequences of the lines (``text``, ``host``) that may be heads of entries."""
    text = F.when(F.length("host") > 2, F.replace("text", F.col("host"), F.lit(f" {M}H "))).otherwise(F.col("text"))
    typed = lines.where("text is not null").select(text.alias("text")).mapInArrow(typed_counts(zone_abbreviations()), "tokens array<string>, head array<string>, cnt long")
    # The first split, by token count and head, is the partitioning as well: what belongs together is combined in the task by
    # all later splits. A partition of many lines is spread over SPREAD tasks.
    placed = typed.withColumns({"pid": F.xxhash64(F.size("tokens"), "head"), "salt": F.pmod(F.xxhash64("tokens"), F.lit(SPREAD))}).repartition("pid", "salt")
    return placed.groupBy("pid", "salt", "tokens", "head").agg(F.sum("cnt").alias("cnt")).drop("salt")


def _class(token: Column) -> Column:
    """As ``line_types.token_class``."""
    typed = F.substring(token, 2, 1)
    return F.when(token.startswith(M), F.when(typed == "R", "w").otherwise(typed)).when(token.rlike(r"^[^\p{L}\p{N}_]+$"), token).otherwise("w")


def _spread(parts: DataFrame) -> DataFrame:
    """``pid, pos, d``: positions with more than one distinct token, and how many."""
    cells = parts.select("pid", F.posexplode("tokens").alias("pos", "tok")).distinct()
    return cells.groupBy("pid", "pos").agg(F.count("*").alias("d")).where("d > 1")


def _split_by_position(parts: DataFrame) -> DataFrame:
    """Split each partition by its position with the fewest distinct tokens above one (ties: leftmost)."""
    chosen = _spread(parts).groupBy("pid").agg(F.min(F.struct("d", "pos")).alias("m")).select("pid", F.col("m.pos").alias("at"))
    key = F.when(F.col("at").isNull(), "").otherwise(F.get("tokens", F.col("at")))
    return lookup_join(parts, cut(chosen), ["pid"], "left", salt_by=F.col("tokens")).withColumn("pid", F.xxhash64("pid", key)).drop("at")


def _split_by_bijection(parts: DataFrame) -> DataFrame:
    """Split by the relation between the tokens of the two leftmost positions that share the most frequent number of distinct tokens."""
    # one row a partition, with at most as many positions as its lines have tokens
    places = _spread(parts).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("ps"))
    same = F.transform("ps", lambda x: F.struct(F.size(F.filter("ps", lambda y: y["d"] == x["d"])).alias("n"), (-x["d"]).alias("d"), x["d"].alias("of")))
    best = F.array_max(F.filter(same, lambda x: x["n"] > 1))["of"]
    two = F.filter("ps", lambda y: y["d"] == best)
    at = cut(places.select("pid", F.get(two, F.lit(0))["pos"].alias("p1"), F.get(two, F.lit(1))["pos"].alias("p2")).where("p2 is not null"))
    pairs = lookup_join(parts, at, ["pid"], "left", salt_by=F.col("tokens")).withColumns({"t1": F.get("tokens", F.col("p1")), "t2": F.get("tokens", F.col("p2"))}).drop("p1", "p2")
    seen = cut(pairs.where("t1 is not null").select("pid", "t1", "t2").distinct())
    one = cut(seen.groupBy("pid", "t1").agg(F.count("*").alias("n12")))
    two = cut(seen.groupBy("pid", "t2").agg(F.count("*").alias("n21")))
    out = lookup_join(lookup_join(pairs, one, ["pid", "t1"], "left", salt_by=F.col("tokens")), two, ["pid", "t2"], "left", salt_by=F.col("tokens"))
    key = F.when(F.col("n12").isNull(), "").when((F.col("n12") == 1) | ((F.col("n12") > 1) & (F.col("n21") == 1)), F.concat(F.lit("1"), "t1")).when(F.col("n21") > 1, F.when(F.col("n12") == 1, F.concat(F.lit("2"), "t2")).otherwise("mm"))
    return out.withColumn("pid", F.xxhash64("pid", F.coalesce(key, F.lit("mm")))).select("pid", "tokens", "head", "cnt")


def templates(shapes: DataFrame) -> DataFrame:
    """``pid, cnt, head, slots``: the leaf templates of ``pid, tokens, head, cnt`` rows.

    ``head`` has the classes of the tokens of its lines' heads. ``slots`` has one struct a position, in order: ``token``
    (null for a variable slot), its least and greatest token ``lo`` and ``hi``, and ``named``, the share of the lines in
    which the slot holds a numbered name such as ``pool-3``.
    """
    parts = shapes
    # each split reads its input several times, so the input is written once
    for split in (_split_by_position, _split_by_bijection, _split_by_position):
        parts = split(cut(parts))
    cells = cut(parts).select("pid", "cnt", "head", F.posexplode("tokens").alias("pos", "tok"))
    slots = cells.groupBy("pid", "pos").agg(
        F.min("tok").alias("lo"),
        F.max("tok").alias("hi"),
        (F.sum(F.when(F.col("tok").startswith(M + "R"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("named"),
        F.sum("cnt").alias("cnt"),
        F.first("head").alias("head"),
    )
    slot = F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("token"), "lo", "hi", "named")
    return slots.groupBy("pid").agg(F.max("cnt").alias("cnt"), F.first("head").alias("head"), F.array_sort(F.collect_list(slot)).alias("slots"))  # as long as a line


def written(leaves: DataFrame) -> DataFrame:
    """``template, slots, cnt``: leaf templates as text, each variable or typed slot as its class in angle brackets."""
    kind = lambda s: F.when(s["token"].isNull() & (_class(s["lo"]) != _class(s["hi"])), "*").otherwise(_class(s["lo"]))
    text = F.array_join(F.transform("slots", lambda s: F.when(s["token"].isNull() | s["token"].startswith(M), F.concat(F.lit("<"), kind(s), F.lit(">"))).otherwise(s["token"])), " ")
    variable = F.size(F.filter("slots", lambda s: s["token"].isNull() | s["token"].startswith(M)))
    return leaves.select(text.alias("template"), variable.alias("slots"), "cnt").groupBy("template", "slots").agg(F.sum("cnt").alias("cnt"))
