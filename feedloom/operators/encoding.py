"""Vocabularies, static tables and feature encoders: fitted with aggregations, applied as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.order import numbered

PAD, OOV = 0, 1


def vocabulary(counts: DataFrame, first: int = 2) -> DataFrame:
    """(id, n, index) for ``counts(id, n)``: the most frequent first, ties to the smaller id; PAD and OOV are reserved."""
    return numbered(counts, [-F.col("n"), F.col("id")], "index", first)


def ordered_union(first: DataFrame, extra: DataFrame) -> DataFrame:
    """Vocabulary of the catalog's ids by frequency, then ids of ``extra`` that it lacks, ascending; (id, n, index)."""
    a = first.select("id", "n", F.lit(0).alias("_g"))
    b = extra.select("id").distinct().join(first.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n"), F.lit(1).alias("_g"))
    return numbered(a.unionByName(b), [F.col("_g"), -F.col("n"), F.col("id")], "index", 2).drop("_g")


def tags(col: str, trim: bool, sep: str = ",") -> Column:
    """Tags of a separated string; with ``trim`` white space around them goes; empty ones go, null gives none."""
    parts = F.split(F.coalesce(F.col(col), F.lit("")), sep)
    return F.filter(F.transform(parts, lambda x: F.trim(x)) if trim else parts, lambda x: x != "")


def fit_standard(df: DataFrame, columns: list[str], log: bool = True, sample: bool = True) -> DataFrame:
    """One row: mean and deviation of each column after log1p, nulls as 0; a deviation of nearly 0 counts as 1."""
    value = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")) if log else F.coalesce(F.col(c), F.lit(0)).cast("double")
    dev = F.stddev_samp if sample else F.stddev_pop
    return df.agg(*[F.avg(value(c)).alias(f"{c}_mean") for c in columns], *[F.when(F.coalesce(dev(value(c)), F.lit(0.0)) <= 1e-12, 1.0).otherwise(dev(value(c))).alias(f"{c}_std") for c in columns])


def apply_standard(df: DataFrame, stats: DataFrame, columns: list[str], log: bool = True) -> DataFrame:
    value = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double")) if log else F.coalesce(F.col(c), F.lit(0)).cast("double")
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[c for c in df.columns if c not in columns], *[((value(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(c) for c in columns])


def category_map(df: DataFrame, col: str) -> DataFrame:
    """(value, code): distinct non-null values as text in their own order from 1; unknown values get 0 when joined."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().transform(numbered, [F.col("value")], "code")


def classify(name: str) -> str:
    """Class of a feature column by its name."""
    if name.endswith("has_history"):
        return "flag"
    if name.endswith("trend"):
        return "trend"
    return "smooth" if "_smooth_" in name else "naive" if "_rate_" in name else "count"


def prior_of(smooth: Column, num: Column, imp: Column, alpha: float) -> Column:
    """The prior that a smoothed rate was made with."""
    return (smooth * (imp + alpha) - num) / alpha


def coverage(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """One row (n, covered, coverage): how many rows have an id that is in ``ids(col)``, each id once there."""
    known = ids.select(col, F.lit(1).alias("_known"))
    return rows.select(col).join(known, col, "left").agg(F.count("*").alias("n"), F.count("_known").alias("covered"), F.avg(F.coalesce("_known", F.lit(0))).alias("coverage"))
