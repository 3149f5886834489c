"""Re-ranking of scored lists."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.retrieval import top_k


def fuse(weights: dict[str, float]) -> Column:
    """Weighted sum of score columns; a null score counts as 0."""
    return functools.reduce(operator.add, [w * F.coalesce(F.col(c), F.lit(0)) for c, w in weights.items()])


def diverse(scored: DataFrame, query: list[str], group: str, most: int, k: int, score: str = "score", item: str = "video_id") -> DataFrame:
    """The k best of each list with at most ``most`` items of a group (author, category); adds ``rank``.

    Ties go to the smaller item. Items without a group form one of their own. Both cuts are made before their shuffle.
    """
    w = Window.partitionBy(*query, group).orderBy(F.desc(score), item)
    few = scored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return top_k(few, query, score, item, k)
