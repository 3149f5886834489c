"""Queries: guards as violation counts, routed tables, conversions, pivots, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import guards, retrieval
from feedloom.plans.common import EV, OR, query
from feedloom.views import CUTS, log_events, log_orders, table, with_split


def _log(spark, sf):
    return with_split(log_events(spark, sf))


@query(f"""WITH {EV}, {OR}, main AS (SELECT video_id FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 20), aux AS (SELECT video_id FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 1)
SELECT 'catalog_within_aux' AS "check", count(*) AS violations FROM main WHERE video_id NOT IN (SELECT video_id FROM aux) UNION ALL SELECT 'empty_catalog', CAST((SELECT count(*) FROM main) = 0 AS BIGINT)
UNION ALL SELECT 'event_repeats', count(*) - count(DISTINCT event_id) FROM lg UNION ALL SELECT 'moment_repeats', count(*) - count(DISTINCT (user_id, ts, video_id)) FROM lo
UNION ALL SELECT 'item_join', abs((SELECT count(*) FROM lo) - (SELECT count(*) FROM lo LEFT JOIN part ON p_partkey = video_id)) UNION ALL SELECT 'answer_outside_catalog', count(DISTINCT video_id) FROM lo WHERE positive = 1 AND year = 2001 AND video_id NOT IN (SELECT video_id FROM main)
UNION ALL SELECT 'label', count(*) FILTER (is_click NOT IN (0, 1)) FROM lg UNION ALL SELECT 'clock', count(*) FILTER (hourmin % 100 > 59 OR hourmin > 2359) FROM lg""")
def guard_counts(spark, sf):
    """What the data must not have, counted: catalogs nest, keys are unique, joins keep rows, answers lie in the catalog."""
    log, orders = _log(spark, sf), log_orders(spark, sf)
    main, aux = (retrieval.catalog(orders.where("year <= 1998"), n).select("video_id") for n in (20, 1))
    joined = orders.join(table(spark, sf, "part").select(F.col("p_partkey").alias("video_id")), "video_id", "left")
    return guards.union(
        guards.not_within(main, aux, ["video_id"], "catalog_within_aux"),
        main.agg((F.count("*") == 0).cast("long").alias("violations")).select(F.lit("empty_catalog").alias("check"), "violations"),
        guards.repeated(log, ["event_id"], "event_repeats"),
        guards.repeated(orders, ["user_id", "ts", "video_id"], "moment_repeats"),
        guards.lost_rows(orders, joined, "item_join"),
        guards.not_within(orders.where("positive = 1 AND year = 2001"), main, ["video_id"], "answer_outside_catalog"),
        guards.checks(log, {"label": ~F.col("is_click").isin(0, 1), "clock": (F.col("hourmin") % 100 > 59) | (F.col("hourmin") > 2359)}),
    )


@query(f"""WITH {EV}, r AS (SELECT tab, is_like AS seed, count(DISTINCT split) AS protocol, count(DISTINCT author_id % 2) AS arch FROM lg GROUP BY 1, 2)
SELECT 'protocol' AS "check", count(*) FILTER (protocol > 1) AS violations FROM r UNION ALL SELECT 'arch', count(*) FILTER (arch > 1) FROM r""")
def comparability(spark, sf):
    """Groups of runs whose protocol or architecture is not the same in all runs."""
    runs = _log(spark, sf).select("tab", F.col("is_like").alias("seed"), F.col("split").alias("protocol"), (F.col("author_id") % 2).alias("arch"))
    return guards.differing(runs, ["tab", "seed"], ["protocol", "arch"])


@query(f"""WITH {EV} SELECT event_id, user_id, video_id, tab, CASE WHEN tab IN (1, 2, 4) THEN 'main' ELSE 'holdout' END AS route FROM lg""")
def scene_tables(spark, sf):
    """The rows of the two routed tables, with the table each goes to."""
    log = _log(spark, sf).select("event_id", "user_id", "video_id", "tab")
    inside = F.col("tab").isin(1, 2, 4)
    return log.where(inside).withColumn("route", F.lit("main")).unionByName(log.where(~inside).withColumn("route", F.lit("holdout")))


@query(f"""WITH {EV}, c AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in CUTS.items())}) t(split, day)), e AS (SELECT split, epoch_us(strptime(CAST(day AS VARCHAR), '%Y%m%d') + INTERVAL 16 HOUR) // 1000 - 1 AS end_ms FROM c)
SELECT e.split, end_ms, count(lg.event_id) AS before_end FROM e LEFT JOIN lg ON lg.time_ms <= end_ms GROUP BY 1, 2""")
def split_ends(spark, sf):
    """The splits' ends as UTC milliseconds, with the events up to each: the cuts by time and by local date agree."""
    log = _log(spark, sf)
    ends = {name: guards.end_of_local_day(F.lit(day)) for name, day in CUTS.items()}
    counts = log.agg(*[F.count_if(F.col("time_ms") <= end).alias(name) for name, end in ends.items()]).unpivot([], list(ends), "split", "before_end")
    chain = F.coalesce(*[F.when(F.col("split") == name, end) for name, end in ends.items()])
    return counts.select("split", chain.alias("end_ms"), "before_end")


@query(f"""WITH {EV} SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE date_diff('day', DATE '1970-01-01', day) END AS INT) AS days, CAST(least(greatest(hourmin // 100, 0), 23) AS INT) AS hour,
coalesce(TRY_CAST(replace(CASE WHEN event_id % 5 = 0 THEN 'none' ELSE strftime(day, '%Y-%m-%d') END, '-', '') AS INT), 0) AS upload FROM lg""")
def date_codes(spark, sf):
    """Days since the epoch (0 for no day), the hour, and dates spelled with hyphens as whole numbers (0 for no number)."""
    log = _log(spark, sf)
    date = F.when(F.col("event_id") % 7 == 0, F.lit(0)).otherwise(F.col("date"))
    spelled = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.date_format(F.to_date(F.col("date").cast("string"), "yyyyMMdd"), "yyyy-MM-dd"))
    return log.select("event_id", guards.days_since_epoch(date).alias("days"), guards.hour_of(F.col("hourmin")).alias("hour"), guards.whole_or_zero(spelled).alias("upload"))


@query(f"""WITH {EV}, m AS (SELECT split, avg(is_click) AS click, avg(long_view) AS view FROM lg GROUP BY 1), b AS (SELECT avg(is_click) AS click, avg(long_view) AS view FROM lg WHERE tab = 0)
SELECT split, round(m.click, 9) AS click, round(m.view, 9) AS view, round(m.click / b.click, 9) AS click_lift, round(m.view / b.view, 9) AS view_lift FROM m, b""")
def metric_pivot(spark, sf):
    """Metrics from rows to columns, and each over its baseline."""
    log = _log(spark, sf)
    means = lambda rows, *by: rows.groupBy(*by).agg(F.avg("is_click").alias("click"), F.avg("long_view").alias("view"))
    long = means(log, "split").unpivot(["split"], ["click", "view"], "metric", "value")
    base = means(log.where("tab = 0")).select(F.col("click").alias("c"), F.col("view").alias("v"))  # one row
    wide = long.groupBy("split").pivot("metric", ["click", "view"]).agg(F.first("value")).crossJoin(base)
    return wide.select("split", F.round("click", 9).alias("click"), F.round("view", 9).alias("view"), F.round(F.col("click") / F.col("c"), 9).alias("click_lift"), F.round(F.col("view") / F.col("v"), 9).alias("view_lift"))


@query(f"""WITH {EV}, r AS (SELECT tab, split, count(*) AS n FROM lg GROUP BY 1, 2) SELECT tab, split, sha256('{{"n":' || n || ',"split":"' || split || '","tab":' || tab || '}}') AS fingerprint FROM r""")
def run_fingerprints(spark, sf):
    """A fingerprint of each run's settings: SHA-256 of their JSON with sorted keys."""
    runs = _log(spark, sf).groupBy("tab", "split").agg(F.count("*").alias("n"))
    return runs.select("tab", "split", guards.fingerprint("tab", "split", "n").alias("fingerprint"))
