"""Negatives by the name of a strategy, one layout for all: (key, slot, negative), and which of them take log q off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import retrieval

#: Names of runs; two that draw alike but differ in the loss are names of their own, so that neither overwrites the other.
STRATEGIES = ("random", "inbatch", "inbatch_logq", "inbatch_full_logq", "exposure", "hybrid")
USES_LOG_Q = ("inbatch_logq", "inbatch_full_logq")
NEEDS_POOL = ("exposure", "hybrid")


def negatives(strategy: str, rows: DataFrame, key: str, target: str, n: int, low: int, high: int, batch: str = "batch", pool: DataFrame | None = None, share: float = 0.5, seed: int = 42, user: str = "user_id") -> DataFrame:
    """(key, slot, negative) for ``rows(key, target, batch, user)`` with items numbered from ``low`` to ``high``.

    ``n`` draws each with replacement; ``inbatch_full_logq`` takes every other row's target of the batch instead, slots in
    the order of keys, so a batch's size bounds what is made. ``exposure`` and ``hybrid`` need ``pool(user, item)``, made
    from training rows only. An unknown name is an error.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}; there are {', '.join(STRATEGIES)}")
    if strategy in NEEDS_POOL and pool is None:
        raise ValueError(f"{strategy} draws from a pool of exposures")
    if strategy == "random":
        return retrieval.random_negatives(rows, key, n, low, high, seed)
    if strategy in ("inbatch", "inbatch_logq"):
        return retrieval.inbatch_negatives(rows, key, batch, target, n, seed)
    if strategy == "inbatch_full_logq":
        other = rows.select(batch, F.col(key).alias("_k"), F.col(target).alias("negative"))
        met = rows.select(key, batch).join(other, batch).where(F.col(key) != F.col("_k"))
        ranks = rows.groupBy(batch).agg(F.array_sort(F.collect_list(key)).alias("_all"))
        return met.join(ranks, batch).select(key, (F.array_position("_all", F.col("_k")) - 1 - (F.col("_k") > F.col(key)).cast("int")).cast("int").alias("slot"), "negative")
    if strategy == "exposure":
        return retrieval.exposure_negatives(rows, pool, key, n, low, high, seed, user).select(key, "slot", "negative")
    return retrieval.hybrid_negatives(rows, pool, key, n, share, low, high, seed, user).select(key, "slot", "negative")


def with_log_q(scores: DataFrame, strategy: str, q: DataFrame, item: str, temperature: float) -> DataFrame:
    """``scores(item, score)`` corrected for every logit, positive and negative alike, where the strategy says so.

    The loss divides by the temperature afterwards, so the correction is scaled by it here.
    """
    if strategy not in USES_LOG_Q:
        return scores
    j = scores.join(q.select(item, F.col("log_q").alias("_q")), item, "left")
    missing = F.raise_error(F.concat(F.lit("no support for item "), F.col(item).cast("string"))).cast("double")
    return j.withColumn("score", F.col("score") - temperature * F.coalesce("_q", missing)).drop("_q")


def normalised(loss: str, candidates: int):
    """A loss as a share of what even guessing among the candidates would lose: ln of their number."""
    if candidates < 2:
        raise ValueError("a loss is normalised among two candidates at least")
    return F.col(loss) / F.log(F.lit(float(candidates)))
