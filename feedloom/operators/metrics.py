"""Offline evaluation: ranking and retrieval metrics as aggregations, without a global sort of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.order import sums_before


def auc(pred: DataFrame, by: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """(by..., n, pos, auc): area under the ROC curve with average ties; null where a class is missing.

    Rows are summed by score first; only distinct scores of a group are ordered, in slices over many tasks.
    """
    at = pred.groupBy(*by, score).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_n"))
    below = sums_before(at, [F.col(score)], {"_below": F.col("_n")}, by)
    g = below.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_u"), F.sum("_p").alias("pos"), F.sum("_n").alias("_neg"))
    return g.select(*by, (F.col("pos") + F.col("_neg")).alias("n"), "pos", F.when((F.col("pos") > 0) & (F.col("_neg") > 0), F.col("_u") / (F.col("pos") * F.col("_neg"))).alias("auc"))


def gauc(pred: DataFrame, user: str, score: str = "p", label: str = "y", weight: str = "n") -> DataFrame:
    """One row: AUC averaged over users by impressions (``n``) or positives (``pos``); users with one class are skipped."""
    a = auc(pred, [user], score, label)
    w = F.when(F.col("auc").isNotNull(), F.col(weight))
    return a.agg((F.sum(F.col("auc") * w) / F.sum(w)).alias("gauc"), F.count("auc").alias("used"), F.sum(F.col("auc").isNull().cast("long")).alias("skipped"))


def pcoc(score: str = "p", label: str = "y") -> Column:
    """Mean prediction over mean outcome; null without positives."""
    return F.avg(score) / F.nullif(F.avg(F.col(label).cast("double")), F.lit(0.0))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank from 1 with ties averaged; distinct values are numbered from their counts."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    ranks = sums_before(counts, [F.col(value)], {"_b": F.col("_c")}).select(value, (F.col("_b") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson correlation of average ranks."""
    return average_rank(average_rank(df, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def calibration(pred: DataFrame, buckets: int, score: str = "p", label: str = "y") -> DataFrame:
    """(bucket, n, mean_pred, mean_label) by average rank; ties share a bucket, so some may be missing."""
    total = pred.agg(F.count("*").alias("_n"))
    at = average_rank(pred, score, "_r").crossJoin(F.broadcast(total))
    bucket = F.least(F.floor((F.col("_r") - 1) * buckets / F.col("_n")), F.lit(buckets - 1)).cast("int")
    return at.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_pred"), F.avg(label).alias("mean_label"))


def ranking_at(hits: DataFrame, request: list[str], ks: list[int]) -> DataFrame:
    """Recall, hit rate and NDCG at each k for ``hits(request..., n_targets, rank)``: a row per request at least.

    ``rank`` is that of a target in the answer, null if it isn't there. The ideal gain sums over min(n_targets, k).
    """
    k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    at = hits.select(*request, "n_targets", "rank", k)
    inside = F.col("rank") <= F.col("k")
    g = at.groupBy(*request, "n_targets", "k").agg(F.sum(F.coalesce(inside.cast("int"), F.lit(0))).alias("_hits"), F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_targets", "k").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return g.select(*request, "k", (F.col("_hits") / F.col("n_targets")).alias("recall"), (F.col("_hits") > 0).cast("double").alias("hitrate"), (F.col("_dcg") / ideal).alias("ndcg"))


def two_averages(per_request: DataFrame, user: str) -> DataFrame:
    """(k, scheme, recall, hitrate, ndcg): the mean over requests, and the mean over users of their means."""
    m = ("recall", "hitrate", "ndcg")
    by_request = per_request.groupBy("k").agg(*[F.avg(c).alias(c) for c in m]).withColumn("scheme", F.lit("per_request"))
    users = per_request.groupBy("k", user).agg(*[F.avg(c).alias(c) for c in m])
    return by_request.unionByName(users.groupBy("k").agg(*[F.avg(c).alias(c) for c in m]).withColumn("scheme", F.lit("per_user")))


def paired_delta(runs: DataFrame, baseline: str) -> DataFrame:
    """(model, metric, n_seeds, mean_delta, std_delta, same_sign) of the difference to the baseline, seed by seed."""
    base = runs.where(F.col("model") == baseline).select("seed", "metric", F.col("value").alias("_b"))
    d = runs.where(F.col("model") != baseline).join(base, ["seed", "metric"]).withColumn("d", F.col("value") - F.col("_b"))
    return d.groupBy("model", "metric").agg(F.count("*").alias("n_seeds"), F.avg("d").alias("mean_delta"), F.stddev_samp("d").alias("std_delta"), (F.bool_and(F.col("d") > 0) | F.bool_and(F.col("d") < 0)).alias("same_sign"))


def frequency_band(freq: str = "train_freq") -> Column:
    return F.when(F.col(freq) < 10, "tail").when(F.col(freq) < 30, "mid").otherwise("warm")


def lift_over_chance(per_request: DataFrame, cat: DataFrame) -> DataFrame:
    """(k, recall, chance, lift): mean recall beside k / items, what k random items of the catalog would find."""
    total = cat.agg(F.count("*").alias("_items"))
    at = per_request.groupBy("k").agg(F.avg("recall").alias("recall")).crossJoin(F.broadcast(total))
    chance = F.col("k") / F.col("_items")
    return at.select("k", "recall", chance.alias("chance"), (F.col("recall") / chance).alias("lift"))


def over_seeds(rows: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """(by..., seeds, mean, std): mean and sample deviation over seeds of each seed's own mean."""
    one = rows.groupBy(*by, seed).agg(F.avg(value).alias("_m"))
    return one.groupBy(*by).agg(F.count("*").alias("seeds"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"))


def dispersion(deltas: DataFrame, a: str, b: str, bar: float = 2.0) -> DataFrame:
    """(metric, ratio, clear_a, clear_b) of ``paired_delta``'s rows: std of a over that of b; |mean| / std reaches ``bar``."""
    def side(model: str, s: str) -> DataFrame:
        clear = F.abs("mean_delta") >= bar * F.col("std_delta")
        return deltas.where(F.col("model") == model).select("metric", F.col("std_delta").alias(f"_{s}"), clear.alias(f"clear_{s}"))

    return side(a, "a").join(side(b, "b"), "metric").select("metric", (F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0))).alias("ratio"), "clear_a", "clear_b")


def prediction_checks(pred: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """(check, violations) from one pass: labels beside 0 and 1, and scores that are null, NaN or outside [0, 1]."""
    p, y = F.col(score), F.col(label)
    bad = {"label": y.isNull() | ~y.isin(0, 1), "missing_score": p.isNull() | F.isnan(p), "score_range": (p < 0) | ((p > 1) & ~F.isnan(p))}
    one = pred.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(name) for name, c in bad.items()])
    return one.unpivot([], list(bad), "check", "violations")
