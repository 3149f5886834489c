"""Connected components as alternating large-star and small-star joins, checkpointed after every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm._shared import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(u, v), u > v. Large: neighbours above u move to u's least neighbour; small: those below and u itself do."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links(a, b)``: the least id that can be reached.

    Ids are long. Null ends, loops and repeated links are ignored; no links give no rows. Each round is two joins on
    keys, no group is gathered in one task, and its result is written to the shared folder. Rounds grow with the
    logarithm of the longest chain; ``most_rounds`` guards against a loop without end and raises.
    """
    at = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at = materialize(at, "links")
    seen = None
    for _ in range(most_rounds):
        mark = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        if not mark[0]:
            break
        at = materialize(_star(_star(at, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return at.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
