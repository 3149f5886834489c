"""Ingest: narrowing, profiles, scene routing, splits and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NARROW = {"tab": "byte", "hourmin": "short", "date": "int", "duration_ms": "int"}


def narrow(df: DataFrame, types: dict[str, str] = NARROW) -> DataFrame:
    """Casts the columns that are there; others are left alone."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def drop_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, rate) for every column, from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("nulls")) for c in df.columns]))
    return one.select("_n", pairs.alias("x")).select("x.column", "x.nulls", (F.col("x.nulls") / F.col("_n")).alias("rate"))


def constant_columns(df: DataFrame) -> DataFrame:
    """(column, distinct): distinct values of every column, null counted as one."""
    one = df.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("long"))).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in df.columns]))
    return one.select(pairs.alias("x")).select("x.column", "x.distinct")


def split_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("split").agg(F.count("*").alias("n"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.countDistinct("user_id").alias("users"), F.countDistinct("video_id").alias("items"), F.sum("is_click").alias("clicks"))


def leakage(log: DataFrame, forbidden: list[str]) -> DataFrame:
    """(check, violations): forbidden columns; dates that differ from the clock; split borders out of order."""
    clock = F.date_format(F.timestamp_millis("time_ms") + F.expr("INTERVAL 8 HOURS"), "yyyyMMdd").cast("int")
    order = {"warmup": 0, "train": 1, "valid": 2, "test": 3}
    ends = log.where(F.col("split").isin(*order)).groupBy("split").agg(F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"))
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    a, b = (ends.select(rank[F.col("split")].alias(f"r{s}"), F.col("lo").alias(f"lo{s}"), F.col("hi").alias(f"hi{s}")) for s in "ab")
    crossed = a.join(b, F.col("ra") < F.col("rb")).where("hia >= lob").agg(F.count("*").alias("violations")).select(F.lit("split_order").alias("check"), "violations")
    dates = log.agg(F.sum((clock != F.col("date")).cast("long")).alias("violations")).select(F.lit("date_clock").alias("check"), "violations")
    cols = log.sparkSession.range(1).select(F.lit("forbidden_columns").alias("check"), F.lit(len(set(forbidden) & set(log.columns))).cast("long").alias("violations"))
    return cols.unionByName(dates).unionByName(crossed)
