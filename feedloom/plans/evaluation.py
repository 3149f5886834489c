"""Queries: AUC, GAUC, calibration, rank correlation, paired differences, re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import metrics, rerank, strict
from feedloom.plans.common import EV, OR, once, query
from feedloom.views import log_events, log_orders, with_split

_PRED = "pr AS (SELECT event_id, user_id, least(greatest(floor(value / 10) / 60, 0), 1) AS p, is_click AS y FROM lg)"


def _pred(spark, sf):
    p = F.least(F.greatest(F.floor(F.col("value") / 10) / 60, F.lit(0.0)), F.lit(1.0))
    return with_split(log_events(spark, sf)).select("event_id", "user_id", p.alias("p"), F.col("is_click").alias("y"))


_AUC = "SELECT {by} sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM (SELECT * FROM pr WHERE y = 1) a JOIN (SELECT * FROM pr WHERE y = 0) b ON {on} {group}"


@query(f"""WITH {EV}, {_PRED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM pr)
SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r""")
def auc_global(spark, sf):
    return metrics.auc(_pred(spark, sf).withColumn("all", F.lit(1)), ["all"]).select("n", "pos", F.round("auc", 9).alias("auc"))


_USER = f"WITH {EV}, {_PRED}, u AS (SELECT user_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM pr GROUP BY 1), x AS ({_AUC.format(by='a.user_id,', on='a.user_id = b.user_id', group='GROUP BY a.user_id')})"


@query(_USER + " SELECT u.user_id, n, pos, round(auc, 9) AS auc FROM u LEFT JOIN x USING (user_id)")
def auc_by_user(spark, sf):
    return metrics.auc(_pred(spark, sf), ["user_id"]).select("user_id", "n", "pos", F.round("auc", 9).alias("auc"))


@query(_USER + " SELECT round(sum(auc * n) / sum(n) FILTER (auc IS NOT NULL), 9) AS gauc, count(auc) AS used, count(*) FILTER (auc IS NULL) AS skipped FROM u LEFT JOIN x USING (user_id)")
def gauc(spark, sf):
    return metrics.gauc(_pred(spark, sf), "user_id").select(F.round("gauc", 9).alias("gauc"), "used", "skipped")


@query(_USER + " SELECT round(sum(auc * pos) / sum(pos) FILTER (auc IS NOT NULL), 9) AS gauc, count(auc) AS used, count(*) FILTER (auc IS NULL) AS skipped FROM u LEFT JOIN x USING (user_id)")
def gauc_by_positives(spark, sf):
    return metrics.gauc(_pred(spark, sf), "user_id", weight="pos").select(F.round("gauc", 9).alias("gauc"), "used", "skipped")


@query(f"WITH {EV}, {_PRED} SELECT round(avg(p) / nullif(avg(y), 0), 9) AS pcoc FROM pr")
def pcoc(spark, sf):
    return _pred(spark, sf).agg(F.round(metrics.pcoc(), 9).alias("pcoc"))


@query(f"""WITH {EV}, {_PRED}, r AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, count(*) OVER () AS n FROM pr)
SELECT CAST(least(floor((r - 1) * 10 / n), 9) AS INT) AS bucket, count(*) AS n, round(avg(p), 9) AS mean_pred, round(avg(y), 9) AS mean_label FROM r GROUP BY 1""")
def calibration(spark, sf):
    return metrics.calibration(_pred(spark, sf), 10).select("bucket", "n", F.round("mean_pred", 9).alias("mean_pred"), F.round("mean_label", 9).alias("mean_label"))


@query(f"""WITH {OR}, i AS (SELECT video_id, count(*) AS n, sum(positive) AS pos FROM lo GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY pos) + (count(*) OVER (PARTITION BY pos) - 1) / 2.0 AS b FROM i) SELECT round(corr(a, b), 9) AS rho FROM r""")
def spearman(spark, sf):
    i = log_orders(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"), F.sum("positive").alias("pos"))
    return metrics.spearman(once(i), "n", "pos").select(F.round("rho", 9).alias("rho"))


@query(f"""WITH {EV}, v AS (SELECT 'm' || tab AS model, CAST(user_id % 3 AS INT) AS seed, unnest(['click', 'view']) AS metric, unnest([is_click, long_view]) AS x FROM lg), r AS (SELECT model, seed, metric, avg(x) AS value FROM v GROUP BY ALL),
d AS (SELECT a.model, a.metric, a.value - b.value AS d FROM r a JOIN r b ON a.seed = b.seed AND a.metric = b.metric AND b.model = 'm0' WHERE a.model <> 'm0')
SELECT model, metric, count(*) AS n_seeds, round(avg(d), 9) AS mean_delta, round(stddev_samp(d), 9) AS std_delta, bool_and(d > 0) OR bool_and(d < 0) AS same_sign FROM d GROUP BY ALL""")
def paired_seed_delta(spark, sf):
    log = with_split(log_events(spark, sf))
    runs = log.groupBy(F.concat(F.lit("m"), "tab").alias("model"), (F.col("user_id") % 3).cast("int").alias("seed")).agg(F.avg("is_click").alias("click"), F.avg("long_view").alias("view")).unpivot(["model", "seed"], ["click", "view"], "metric", "value")
    return metrics.paired_delta(runs, "m0").select("model", "metric", "n_seeds", F.round("mean_delta", 9).alias("mean_delta"), F.round("std_delta", 9).alias("std_delta"), "same_sign")


@query(f"""WITH {EV}, s AS (SELECT user_id, author_id, video_id, max(0.7 * is_click + 0.3 * long_view + value / 1e6) AS score FROM lg GROUP BY ALL), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, author_id ORDER BY score DESC, video_id) AS k FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, video_id) AS rank FROM a WHERE k <= 2) SELECT user_id, author_id, video_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM t WHERE rank <= 10""")
def author_diversity(spark, sf):
    """Extension: fused scores, re-ranked with at most two items of an author in a list."""
    fused = F.max(0.7 * F.col("is_click") + 0.3 * F.col("long_view") + F.col("value") / 1e6).alias("score")
    s = with_split(log_events(spark, sf)).groupBy("user_id", "author_id", "video_id").agg(fused)
    return rerank.diverse(s, ["user_id"], "author_id", 2, 10).select("user_id", "author_id", "video_id", F.round("score", 9).alias("score"), "rank")


@query(_USER + f""", r AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, count(*) OVER () AS n FROM pr), c AS (SELECT CAST(least(floor((r - 1) * 10 / n), 9) AS INT) AS bucket, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM r GROUP BY 1),
m AS (SELECT 'n' AS metric, CAST(NULL AS INT) AS bucket, CAST(count(*) AS DOUBLE) AS value FROM pr UNION ALL SELECT 'pos_rate', NULL, avg(y) FROM pr UNION ALL SELECT 'pcoc', NULL, avg(p) / nullif(avg(y), 0) FROM pr
UNION ALL SELECT 'auc', NULL, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) FROM r UNION ALL SELECT 'gauc', NULL, sum(auc * u.n) / sum(u.n) FILTER (auc IS NOT NULL) FROM u LEFT JOIN x USING (user_id)
UNION ALL SELECT 'gauc_users', NULL, count(auc) FROM u LEFT JOIN x USING (user_id) UNION ALL SELECT 'gauc_skipped', NULL, count(*) FILTER (auc IS NULL) FROM u LEFT JOIN x USING (user_id)
UNION ALL SELECT 'calibration_n', bucket, n FROM c UNION ALL SELECT 'calibration_pred', bucket, mp FROM c UNION ALL SELECT 'calibration_label', bucket, my FROM c) SELECT metric, bucket, round(value, 9) AS value FROM m""")
def ranking_bundle(spark, sf):
    """All ranking metrics of one set of predictions, which are checked on the way."""
    return strict.evaluate_ranking(_pred(spark, sf), "user_id").select("metric", "bucket", F.round("value", 9).alias("value"))
