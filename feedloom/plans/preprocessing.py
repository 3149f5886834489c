"""Queries: profiles, splits, leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import ingest
from feedloom.plans.common import EV, query
from feedloom.views import LABELS, log_events, table, with_split


@query(f"WITH {EV} SELECT event_id, time_ms, date, hourmin FROM ev")
def date_rebuild(spark, sf):
    return log_events(spark, sf).select("event_id", "time_ms", "date", "hourmin")


@query(f"WITH {EV} SELECT split, count(*) AS n, min(time_ms) AS first_ms, max(time_ms) AS last_ms, count(DISTINCT user_id) AS users, count(DISTINCT video_id) AS items, CAST(sum(is_click) AS BIGINT) AS clicks FROM lg GROUP BY split")
def split_stats(spark, sf):
    return ingest.split_stats(with_split(log_events(spark, sf)))


@query("""SELECT 'c_custkey' AS "column", count(*) FILTER (c_custkey IS NULL) AS nulls, count(*) FILTER (c_custkey IS NULL) / count(*) AS rate FROM customer
UNION ALL SELECT 'c_name', count(*) FILTER (c_name IS NULL), count(*) FILTER (c_name IS NULL) / count(*) FROM customer
UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL), count(*) FILTER (c_nationkey IS NULL) / count(*) FROM customer
UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL), count(*) FILTER (c_acctbal IS NULL) / count(*) FROM customer
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL), count(*) FILTER (c_mktsegment IS NULL) / count(*) FROM customer""")
def null_profile(spark, sf):
    return ingest.null_profile(table(spark, sf, "customer"))


@query("""SELECT 'l_linenumber' AS "column", count(DISTINCT l_linenumber) + max(CAST(l_linenumber IS NULL AS BIGINT)) AS "distinct" FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) + max(CAST(l_returnflag IS NULL AS BIGINT)) FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) + max(CAST(l_linestatus IS NULL AS BIGINT)) FROM lineitem""")
def constant_columns(spark, sf):
    return ingest.constant_columns(table(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus"))


@query(f"WITH {EV} SELECT date, count(*) AS imp, count(DISTINCT user_id) AS users, count(DISTINCT video_id) AS items, round(avg(is_click), 9) AS click_rate FROM lg GROUP BY date")
def day_profile(spark, sf):
    return log_events(spark, sf).groupBy("date").agg(F.count("*").alias("imp"), F.countDistinct("user_id").alias("users"), F.countDistinct("video_id").alias("items"), F.round(F.avg("is_click"), 9).alias("click_rate"))


@query(f"WITH {EV} SELECT tab, count(*) AS n, round(avg(is_click), 9) AS click_rate, round(avg(value) FILTER (is_click = 1), 6) AS value_if_click FROM lg GROUP BY tab")
def tab_profile(spark, sf):
    return log_events(spark, sf).groupBy("tab").agg(F.count("*").alias("n"), F.round(F.avg("is_click"), 9).alias("click_rate"), F.round(F.avg(F.when(F.col("is_click") == 1, F.col("value"))), 6).alias("value_if_click"))


@query(f"WITH {EV}, x AS (UNPIVOT (SELECT avg(is_click) AS is_click, avg(long_view) AS long_view, avg(is_like) AS is_like, avg(is_comment) AS is_comment, avg(is_follow) AS is_follow FROM lg) ON is_click, long_view, is_like, is_comment, is_follow INTO NAME label VALUE rate) SELECT label, round(rate, 9) AS rate, CASE WHEN rate < 0.001 THEN 'very rare' WHEN rate < 0.01 THEN 'rare' ELSE 'common' END AS bucket FROM x")
def label_profile(spark, sf):
    means = log_events(spark, sf).agg(*[F.avg(c).alias(c) for c in LABELS])
    x = means.unpivot([], list(LABELS), "label", "rate")
    return x.select("label", F.round("rate", 9).alias("rate"), F.when(F.col("rate") < 0.001, "very rare").when(F.col("rate") < 0.01, "rare").otherwise("common").alias("bucket"))


@query(f"WITH {EV} SELECT CASE WHEN tab IN (1, 2, 4) THEN 'main' ELSE 'holdout' END AS scene, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY 1")
def scene_routing(spark, sf):
    scene = F.when(F.col("tab").isin(1, 2, 4), "main").otherwise("holdout").alias("scene")
    return ingest.narrow(log_events(spark, sf)).groupBy(scene).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"""WITH {EV}, ends AS (SELECT CASE split WHEN 'warmup' THEN 0 WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END AS r, min(time_ms) AS lo, max(time_ms) AS hi FROM lg WHERE split <> 'unused' GROUP BY split)
SELECT 'forbidden_columns' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'date_clock', count(*) FILTER (CAST(strftime(make_timestamp(time_ms * 1000) + INTERVAL 8 HOUR, '%Y%m%d') AS INT) <> date) FROM lg
UNION ALL SELECT 'split_order', count(*) FROM ends a JOIN ends b ON a.r < b.r WHERE a.hi >= b.lo""")
def leakage_checks(spark, sf):
    return ingest.leakage(with_split(log_events(spark, sf)), ["play_time_ms", "profile_stay_time"])


@query(f"WITH {EV} SELECT user_id, count(*) AS n FROM ev WHERE ('0x' || substr(md5('42|' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 10 < 3 GROUP BY user_id")
def user_sample(spark, sf):
    """Extension: a sample of whole users by hash."""
    from feedloom.operators.retrieval import draw

    return log_events(spark, sf).where(draw(42, "user_id") % 10 < 3).groupBy("user_id").agg(F.count("*").alias("n"))
