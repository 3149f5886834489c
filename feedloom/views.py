"""Domain views over the given tables: an interaction log, an order log, side tables, vectors and predictions.

Every operator takes plain DataFrames; these views only say which columns play which part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends of the splits, local days (UTC+8), as YYYYMMDD; what comes later is unused.
CUTS = {"warmup": 20240107, "train": 20240122, "valid": 20240126, "test": 20240130}
LABELS = ("is_click", "long_view", "is_like", "is_comment", "is_follow")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event, with labels by type; time in epoch milliseconds, date and hourmin on the UTC+8 clock."""
    e = table(spark, sf_dir, "events")
    local = F.col("ts").cast("timestamp") + F.expr("INTERVAL 8 HOURS")
    kinds = dict(zip(LABELS, ("click", "view", "purchase", "signup", "error"), strict=True))
    video = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", F.col("user_id").cast("long").alias("user_id"), video.alias("video_id"), (video % 20).alias("author_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("time_ms"),
        F.date_format(local, "yyyyMMdd").cast("int").alias("date"), (F.hour(local) * 100 + F.minute(local)).alias("hourmin"),
        *[(F.col("event_type") == kind).cast("int").alias(label) for label, kind in kinds.items()],
        (F.col("value") * 1000).cast("int").alias("duration_ms"), (F.col("event_id") % 5).cast("int").alias("tab"), "value",
    )


def with_split(log: DataFrame, cuts: dict[str, int] = CUTS) -> DataFrame:
    """Adds ``split`` by the local date; the chain of conditions follows the order of the cuts."""
    chain = None
    for name, end in cuts.items():
        cond = F.col("date") <= end
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return log.withColumn("split", chain.otherwise("unused"))


def log_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: several items share a user's moment, so it exercises ties."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("video_id"), F.col("l_suppkey").alias("author_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("l_returnflag") == "R").cast("int").alias("positive"), F.year("o_orderdate").alias("year"),
    )
