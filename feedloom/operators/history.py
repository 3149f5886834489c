"""Strict as-of histories: the last items of a user before a moment, nothing of the moment itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(positives: DataFrame, user: str, time: str, item: str, n: int) -> DataFrame:
    """(user, time, hist): for each moment with positives, the user's n latest items up to and with it, newest first.

    Items of one moment are ordered by item; the larger counts as newer.
    """
    w = Window.partitionBy(user).orderBy(time, item).rowsBetween(-(n - 1), 0)
    upto = positives.withColumn("hist", F.reverse(F.collect_list(item).over(w)))
    return upto.groupBy(user, time).agg(F.max_by("hist", item).alias("hist"))


def strict_history(moments: DataFrame, positives: DataFrame, user: str = "user_id", time: str = "time_ms", item: str = "video_id", n: int = 50) -> DataFrame:
    """``moments(user, time)`` with ``hist``: the state of the latest positive moment strictly before; empty if none.

    A backward as-of join as one window: states and moments are united by key, and each row takes the last state in the
    range that ends just before its own time. Positives are repartitioned by user once and no pair is made.
    """
    states = last_n(positives, user, time, item, n).withColumn("_kind", F.lit(0))
    asked = moments.select(user, time).distinct().withColumn("hist", F.lit(None).cast(states.schema["hist"].dataType)).withColumn("_kind", F.lit(1))
    clock = F.unix_micros(time) if states.schema[time].dataType.simpleString() == "timestamp" else F.col(time).cast("long")
    w = Window.partitionBy(user).orderBy("_clock").rangeBetween(Window.unboundedPreceding, -1)
    both = states.unionByName(asked).withColumn("_clock", clock).withColumn("hist", F.last("hist", ignorenulls=True).over(w))
    out = both.where("_kind = 1").select(user, time, F.coalesce("hist", F.array().cast(states.schema["hist"].dataType)).alias("hist"))
    return out.withColumn("hist_len", F.size("hist"))


def all_before(moments: DataFrame, positives: DataFrame, user: str = "user_id", time: str = "time_ms", item: str = "video_id") -> DataFrame:
    """(user, time, item): every distinct item that was positive strictly before the moment."""
    first = positives.groupBy(user, item).agg(F.min(time).alias("_first"))
    return moments.select(user, time).distinct().join(first, user).where(F.col("_first") < F.col(time)).select(user, time, item)


def map_history(histories: DataFrame, vocab: DataFrame, keys: list[str], unknown: int = 1) -> DataFrame:
    """``hist_idx``: items replaced by vocabulary indices in order; unknown items get ``unknown``, empty stays empty."""
    placed = histories.select(*keys, F.posexplode("hist").alias("pos", "id"))
    mapped = placed.join(vocab.select("id", "index"), "id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("index", F.lit(unknown)).alias("index")))).alias("_s"))
    out = histories.join(mapped, keys, "left")
    return out.withColumn("hist_idx", F.coalesce(F.transform("_s", lambda x: x["index"]), F.array().cast("array<int>"))).drop("_s")


def pad(array: str, width: int):
    """The first ``width`` elements, filled up with 0."""
    return F.slice(F.concat(F.col(array), F.array_repeat(F.lit(0), width)), 1, width)
