"""Problem 8: records of several sources in target shares of the total size in tokens.

Poisson replication: a source with S tokens that shall give w of T tokens needs a mean of w*T/S copies of a document.
Each document's number of copies comes from a Poisson distribution truncated at the source's cap, inverted at a uniform
number hashed from seed and document, so it depends on nothing else. The distribution's rate is solved for the mean
after truncation; a source which cannot reach its share gives every document as often as allowed. The copies are
exploded, their texts joined by id, and all is shuffled globally by another hash.

A source that cannot reach its share (too few documents, too low a cap, or none) gives what it may; the others keep their
ratios, so each has a renormalised share: what the short sources leave, divided by target (``shares``).

T is ``total_tokens``, by default the tokens of all documents whose source has a weight.

Defined results: documents with null or unknown source, or without tokens, are not used; sources without documents have
an actual share of 0; null, negative or missing weights and caps count as 0; repeated rows of a document are one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join, table
from .tokenise import VOCABULARY, token_ids

SEED = 17


def truncated_mean(rate: float, cap: int) -> float:
    """Mean of min(Poisson(rate), cap)."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * (1.0 - below)


def thresholds(mean: float, cap: int) -> list[float]:
    """Cumulative probabilities of 0, 1, ... cap-1 copies for a wanted mean; a document's copies are the thresholds at or below its uniform number."""
    if cap <= 0 or mean <= 0:
        return []
    if mean >= cap:
        return [0.0] * cap
    lo, hi = 0.0, 1.0
    while truncated_mean(hi, cap) < mean and hi < 600:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if truncated_mean(mid, cap) < mean else (lo, mid)
    out, p, total = [], math.exp(-hi), 0.0
    for k in range(cap):
        total += p
        out.append(min(total, 1.0))
        p *= hi / (k + 1)
    return out


def plan(sizes: dict[str, int], weights: list[tuple[str, float, int]], total_tokens: int | None = None) -> dict[str, list[float]]:
    """Thresholds of every source. ``sizes``: tokens by source; ``weights``: source, target share, cap."""
    known = [(s, max(w or 0.0, 0.0), max(c or 0, 0)) for s, w, c in weights if s is not None]
    whole = total_tokens if total_tokens is not None else sum(sizes.get(s, 0) for s, _, _ in known)
    share = sum(w for _, w, _ in known) or 1.0
    return {s: thresholds(w / share * whole / sizes[s], c) if sizes.get(s) else [] for s, w, c in known}


def sized(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of documents with a source and at least one token."""
    d = docs.select("doc_id", "source", "text").where("source is not null and text is not null and text <> ''")
    # repeated rows go after the texts are counted: only ids and numbers are shuffled
    return token_ids(d, keep=["doc_id", "source"], path=path, counts_only=True).where("n_tokens > 0").dropDuplicates(["doc_id"])


def mixture(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = SEED, path: str = VOCABULARY, texts: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, copy, n_tokens, shuffle_key`` and, with ``texts``, ``text`` of the mixture in a globally shuffled order:
    a record's place is its ``shuffle_key``, partitions and the order within them follow it. ``counted``: ``sized(docs)``, if at hand."""
    d = cut(sized(docs, path)) if counted is None else counted
    # one row per source that has a weight: the weights' table is a configuration, as long as it has sources
    sizes = {r["source"]: r["n"] for r in _available(d, weights).collect()}
    rows = [(r["source"], r["target_share"], r["max_repeat"]) for r in weights.select("source", "target_share", "max_repeat").distinct().collect()]
    cuts = plan(sizes, rows, total_tokens)
    spark = docs.sparkSession
    rates = spark.createDataFrame(list(cuts.items()) or [("", [])], "source string, steps array<double>")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)).cast("double") / F.lit(float(1 << 53))
    drawn = lookup_join(d, rates, ["source"], "inner", salt_by=F.col("doc_id")).withColumn("u", uniform)
    some = drawn.withColumn("copies", F.size(F.filter("steps", lambda t: t <= F.col("u")))).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    if texts:
        # each document once, also if its row is repeated
        some = some.join(docs.select("doc_id", "text").where("text is not null"), "doc_id").dropDuplicates(["doc_id"])
    out = some.select("doc_id", "source", "n_tokens", *(["text"] if texts else []), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy").select("doc_id", "source", "copy", "n_tokens", "shuffle_key", *(["text"] if texts else []))


def _available(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """``source, n``: tokens of the sources that have a weight."""
    return lookup_join(counted, weights.select("source").distinct(), ["source"], "left_semi", salt_by=F.col("doc_id")).groupBy("source").agg(F.sum("n_tokens").alias("n"))


def shares(mixed: DataFrame, weights: DataFrame, counted: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Every source with a weight: ``source, target_share, max_repeat, n_documents, n_copies, most_copies, n_tokens,
    actual_share, reachable, renormalised_share``. ``reachable``: the source has the tokens for its share under its cap;
    ``renormalised_share``: what it can be held to, its actual share if it falls short."""
    by_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("n"))
    got = by_doc.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum("n").alias("n_tokens"))
    w = weights.select("source", "target_share", "max_repeat").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = w.join(got, "source", "left").join(_available(counted, weights), "source", "left")
    rows = rows.select("source", "target_share", "max_repeat", zero("n_documents"), zero("n_copies"), zero("most_copies"), zero("n_tokens"), F.coalesce("n", F.lit(0)).alias("has"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("wanted"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("cap"))
    # sums over the table of sources, which is a configuration
    every = Window.partitionBy(F.lit(1))
    whole = F.lit(total_tokens) if total_tokens is not None else F.sum("has").over(every)
    rows = rows.withColumn("reachable", F.col("cap") * F.col("has") > F.col("wanted") / F.greatest(F.sum("wanted").over(every), F.lit(1e-12)) * whole)
    rows = rows.withColumn("actual", F.col("n_tokens") / F.greatest(F.sum("n_tokens").over(every), F.lit(1)))
    left = 1 - F.sum(F.when(F.col("reachable"), 0.0).otherwise(F.col("actual"))).over(every)
    held = F.col("wanted") / F.greatest(F.sum(F.when(F.col("reachable"), F.col("wanted")).otherwise(0.0)).over(every), F.lit(1e-12)) * left
    return rows.select("source", "target_share", "max_repeat", "n_documents", "n_copies", "most_copies", "n_tokens", F.round("actual", 6).alias("actual_share"), "reachable", F.round(F.when(F.col("reachable"), held).otherwise(F.col("actual")), 6).alias("renormalised_share"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents by mix_weight, with their texts."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_weight"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's actual share in the mixture, whether it can reach its target, and the share it is held to."""
    docs, weights = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_weight")
    counted = cut(sized(docs))
    return shares(mixture(docs, weights, texts=False, counted=counted), weights, counted)
