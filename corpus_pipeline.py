"""The corpus pipeline: five training-data operators, each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import decontam, mixing, quality, simhash, tokens
from feedloom.llm._shared import new_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _beside(docs: DataFrame, made: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work``, which adds the columns ``made``, on ``docs``: those of ``docs`` keep their values, also under such names."""
    taken = {c.lower() for c in docs.columns}
    names = {c: c for c in docs.columns}
    for c in docs.columns:
        if c.lower() in made:
            while names[c].lower() in taken | set(made):
                names[c] += "_"
            taken.add(names[c].lower())
    done = work(docs.select(*[docs[f"`{c}`"].alias(n) for c, n in names.items()]))
    return done.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = _table(spark, sf_dir, "labels")
    return _beside(docs, ("held_out", "score", "predicted"), lambda d: quality.classify(d, labels).where("predicted = 1"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    benchmark = _table(spark, sf_dir, "benchmark")
    return _beside(docs, made, lambda d: decontam.contamination(d, benchmark).where(~F.col("contaminated")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row for each document of the mix, copies included."""
    return tokens.token_table(docs)


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", deduplicate), ("benchmark_decontamination", decontaminate), ("source_mixing", mix), ("token_output", to_tokens)]

#: The classifier and the token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
