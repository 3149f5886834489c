"""Interval joins: an equality on keys and a point that lies in an interval, through bins instead of nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(intervals: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, at: str, width: int, how: str = "inner") -> DataFrame:
    """Each row of ``intervals(keys..., low, high)`` with each row of ``points(keys..., at)`` of its keys for which
    low <= at <= high; all columns of both, the keys once.

    The line is cut in bins of ``width``: an interval is written once for each bin it meets, a point once for its own, so
    each pair meets in one bin only and the join is an equality on (keys, bin). A width near the intervals' length writes
    each about twice. ``low``, ``high`` and ``at`` are whole numbers or dates; a null key or bound matches nothing. ``how``
    may be ``left``: rows of ``intervals`` without a point come once, with nulls; rows that repeat are told apart.
    """
    if width < 1:
        raise ValueError("a bin is at least 1 wide")
    if how not in ("inner", "left"):
        raise ValueError(f"no such interval join: {how}")

    def number(c: str, df: DataFrame):
        return F.unix_date(c) if df.schema[c].dataType.simpleString() == "date" else F.col(c).cast("long")

    bin_of = lambda x: F.floor(x / width).cast("long")
    left = intervals.withColumn("_id", F.monotonically_increasing_id()) if how == "left" else intervals
    spread = left.withColumn("_low", number(low, intervals)).withColumn("_high", number(high, intervals))
    if how == "inner":
        spread = spread.where("_low <= _high")
    binned = spread.withColumn("_bin", F.explode(F.when(F.col("_low") <= F.col("_high"), F.sequence(bin_of(F.col("_low")), bin_of(F.col("_high")))).otherwise(F.array(F.lit(None).cast("long")))))
    other = [c for c in points.columns if c not in keys]
    clash = set(other) & set(intervals.columns)
    if clash:
        raise ValueError(f"columns of both sides beside the keys: {sorted(clash)}")
    placed = points.withColumn("_at", number(at, points)).withColumn("_bin", bin_of(F.col("_at")))
    met = binned.join(placed, [*keys, "_bin"]).where((F.col("_low") <= F.col("_at")) & (F.col("_at") <= F.col("_high")))
    if how == "inner":
        return met.select(*intervals.columns, *other)
    alone = left.join(met.select("_id").distinct(), "_id", "left_anti")
    kinds = {f.name: f.dataType for f in points.schema.fields}
    return met.select(*intervals.columns, *other).unionByName(alone.select(*intervals.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in other]))
