"""Query: two towers trained on the training split and judged request by request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import history, metrics, order, retrieval, towers
from feedloom.plans.common import query
from feedloom.views import log_events, with_split

_POS = ["is_click", "long_view"]
NEGATIVES = 8
FEATURES = ["hour", "log_hist_len", *[f"tab{k}" for k in range(5)]]
SIDE = ["log_freq"]


def uniform(rows: DataFrame, cat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Negatives drawn evenly from the catalog, without a correction."""
    numbers = order.numbered(cat.select("video_id"), [F.col("video_id")], "_i")
    drawn = retrieval.random_negatives(rows, "row_id", NEGATIVES, 1, cat.count())
    return drawn.withColumnRenamed("negative", "_i").join(numbers, "_i").select("row_id", "slot", F.col("video_id").alias("negative")), cat.withColumn("log_q", F.lit(0.0))


def in_batch(rows: DataFrame, cat: DataFrame, corrected: bool) -> tuple[DataFrame, DataFrame]:
    """Negatives drawn from the targets of the row's batch; ``corrected`` takes the log of their share off the scores."""
    batches = rows.withColumn("_batch", F.floor(F.col("row_id") / 256))
    drawn = retrieval.inbatch_negatives(batches, "row_id", "_batch", "video_id", NEGATIVES)
    q = retrieval.log_q(rows).select("video_id", "log_q") if corrected else cat.select("video_id", F.lit(0.0).alias("log_q"))
    return drawn, cat.join(q, "video_id", "left")


SAMPLERS = {"random": uniform, "inbatch": lambda rows, cat: in_batch(rows, cat, False), "inbatch_logq": lambda rows, cat: in_batch(rows, cat, True)}


@query()
def two_tower_metrics(spark, sf):
    """Recall, hit rate and NDCG of towers with side features, by sampler, beside what chance would find (no SQL: training)."""
    log = with_split(log_events(spark, sf))
    cat = retrieval.catalog(log.where("split IN ('warmup', 'train')"), 5).withColumn("log_freq", F.log1p("train_freq") / 5)
    positives = log.where(retrieval.positive(_POS) & F.col("video_id").isNotNull())
    states = positives.select("user_id", "time_ms", "video_id").distinct()

    def ready(rows: DataFrame) -> DataFrame:
        kept = rows.join(cat.select("video_id"), "video_id", "left_semi")
        with_hist = kept.join(history.strict_history(kept, states, n=20), ["user_id", "time_ms"])
        tabs = [(F.col("tab") == k).cast("double").alias(f"tab{k}") for k in range(5)]
        return with_hist.select(F.col("event_id").alias("row_id"), "user_id", "time_ms", "video_id", "hist", (F.floor(F.col("hourmin") / 100) / 24).alias("hour"), (F.log1p("hist_len") / 3).alias("log_hist_len"), *tabs)

    train, test = ready(positives.where("split = 'train'")), ready(positives.where("split = 'test'"))
    asked = test.groupBy("user_id", "time_ms").agg(F.min_by(F.struct("row_id", "hist", *FEATURES), "row_id").alias("r"), F.collect_set("video_id").alias("targets")).select("r.*", "targets")
    wanted = asked.select("row_id", F.size("targets").alias("n_targets"), F.explode("targets").alias("item_id"))
    out = None
    for name, sampler in SAMPLERS.items():
        negatives, items = sampler(train, cat)
        net, _ = towers.fit(train, negatives, items, towers.Towers(len(FEATURES), len(SIDE)), FEATURES, SIDE)
        top = retrieval.exact_top_k(towers.user_vectors(asked, net, FEATURES), towers.item_vectors(cat, net, SIDE), 50)
        hits = wanted.join(top.select(F.col("query_id").alias("row_id"), "item_id", "rank"), ["row_id", "item_id"], "left")
        per = metrics.ranking_at(hits, ["row_id"], [10, 50])
        one = per.groupBy("k").agg(F.count("*").alias("requests"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "hitrate", "ndcg")])
        lift = metrics.lift_over_chance(per, cat).select("k", F.round("chance", 6).alias("chance"))
        one = one.join(lift, "k").select(F.lit(name).alias("sampler"), "k", "requests", "recall", "hitrate", "ndcg", "chance")
        out = one if out is None else out.unionByName(one)
    return out
