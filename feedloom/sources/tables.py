"""Reading and writing of tables, run results and manifests."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_files(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV files of a pattern, joined by column name; columns that a file lacks are null. No file is an error."""
    files = spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").collect()  # names, not contents
    if not files:
        raise FileNotFoundError(pattern)
    parts = [spark.read.option("header", True).option("inferSchema", True).csv(r["path"]) for r in files]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_table(df: DataFrame, path: str) -> int:
    """Writes Parquet (zstd) in place of what was there; returns the rows written, from the files' footers."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of the files of a pattern. Artifact files up to 2 GB each; files are dealt over tasks."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def compare_manifests(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): ``same``, ``changed``, ``missing`` (recorded only) or ``added`` (now only)."""
    both = recorded.select("path", F.col("sha256").alias("_a")).join(now.select("path", F.col("sha256").alias("_b")), "path", "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return both.select("path", status.alias("status"))


def load_runs(spark: SparkSession, pattern: str, protocol: str | None = None, smoke: bool = False) -> DataFrame:
    """Result files of runs, one JSON object each, with ``run`` from the file's name and ``n_neg`` from its ``_negN``.

    Smoke runs are left out unless asked for; ``protocol`` keeps the runs of one.
    """
    runs = spark.read.option("multiLine", True).json(pattern).withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    runs = runs.withColumn("n_neg", F.nullif(F.regexp_extract("run", r"_neg(\d+)", 1), F.lit("")).cast("int"))
    if not smoke:
        runs = runs.where(~F.col("run").contains("smoke"))
        if "smoke" in runs.columns:
            runs = runs.where(~F.coalesce(F.col("smoke").cast("boolean"), F.lit(False)))
    return runs.where(F.col("protocol") == protocol) if protocol else runs
