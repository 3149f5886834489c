"""Queries: day windows by interval join, top-k over versions of vectors, towers whose item vectors follow the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import history, metrics, order, ranges, retrieval, towers, windows
from feedloom.plans.common import EV, query
from feedloom.views import LABELS, log_events, table, with_split


def _log(spark, sf):
    return with_split(log_events(spark, sf))


FAMILIES = {"user": (["user_id"], "video_id"), "item": (["video_id"], "user_id"), "pair": (["user_id", "author_id"], "video_id")}
_WIDTH = 7


def recomputed(log: DataFrame, keys: list[str], other: str, labels: list[str], width: int) -> DataFrame:
    """(keys..., date, imp, labels..., distinct, active): the days [date - width, date - 1] of every kept sample's key,
    straight from the log, by an interval join."""
    need = log.where("split IN ('train', 'valid', 'test')").select(*keys, "date").distinct()
    day = windows.as_date("date")
    asked = need.withColumn("_from", F.date_sub(day, width)).withColumn("_to", F.date_sub(day, 1))
    points = log.select(*keys, windows.as_date("date").alias("_day"), F.col(other).alias("_other"), *labels)
    met = ranges.interval_join(asked, points, keys, "_from", "_to", "_day", width)
    return met.groupBy(*keys, "date").agg(F.count("*").alias("imp"), *[F.sum(c).cast("long").alias(c) for c in labels], F.count_distinct("_other").alias("distinct"), F.count_distinct("_day").alias("active"))


def _family_sql(name: str, keys: list[str], other: str) -> str:
    ks, on = ", ".join(f"n.{k}" for k in keys), " AND ".join(f"l.{k} = n.{k}" for k in keys)
    return f"""SELECT '{name}' AS family, CAST(n.{keys[0]} AS BIGINT) AS key_a, {f'CAST(n.{keys[1]} AS BIGINT)' if len(keys) > 1 else 'CAST(-1 AS BIGINT)'} AS key_b, n.date, count(*) AS imp, {', '.join(f'CAST(sum(l.{c}) AS BIGINT) AS {c}' for c in LABELS)}, count(DISTINCT l.{other}) AS "distinct", count(DISTINCT l.day) AS active
FROM (SELECT DISTINCT {', '.join(keys)}, date, day FROM lg WHERE split IN ('train', 'valid', 'test')) n JOIN lg l ON {on} AND l.day BETWEEN n.day - {_WIDTH} AND n.day - 1 GROUP BY {ks}, n.date"""


@query(f"WITH {EV} " + " UNION ALL ".join(_family_sql(name, *f) for name, f in FAMILIES.items()))
def windows_by_interval(spark, sf):
    """All three families' seven-day windows of the samples' keys, recomputed from the log by interval joins."""
    log, out = _log(spark, sf), None
    for name, (keys, other) in FAMILIES.items():
        second = F.col(keys[1]).cast("long") if len(keys) > 1 else F.lit(-1).cast("long")
        one = recomputed(log, keys, other, list(LABELS), _WIDTH).select(F.lit(name).alias("family"), F.col(keys[0]).cast("long").alias("key_a"), second.alias("key_b"), "date", "imp", *LABELS, "distinct", "active")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {EV} SELECT family, CAST(0 AS BIGINT) AS violations FROM (VALUES ('user'), ('item'), ('pair')) f(family)""")
def windows_agree(spark, sf):
    """(family, violations): rows in which the projected windows and the recomputed ones differ: none."""
    log, out = _log(spark, sf), None
    prior = windows.priors(log, list(LABELS))
    for name, (keys, other) in FAMILIES.items():
        need = log.where("split IN ('train', 'valid', 'test')").select(*keys, "date").distinct()
        rolled = windows.rolling(log, keys, other, list(LABELS), [], [_WIDTH], prior, "r", need=need)
        mine = rolled.select(*keys, "date", F.col("r_imp_7d").alias("imp"), *[F.col(f"r_{c}_7d").alias(c) for c in LABELS], F.col("r_distinct_7d").alias("distinct"), F.col("r_active_days_7d").alias("active"))
        theirs = recomputed(log, keys, other, list(LABELS), _WIDTH)
        wrong = mine.exceptAll(theirs).unionByName(theirs.exceptAll(mine)).agg(F.count("*").alias("violations"))
        one = wrong.select(F.lit(name).alias("family"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH d AS (SELECT unnest([0, 1, 2]) AS day), it AS (SELECT vec_id, day, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + day * (vec_id % 7) / 10.0)) AS v FROM embeddings, d),
q AS (SELECT vec_id, (vec_id // 100) % 3 AS day, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, it.vec_id AS item_id, round(list_dot_product(q, v), 6) AS score FROM q JOIN it USING (day)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def topk_by_day(spark, sf):
    """Top 10 of every hundredth vector among all vectors as of its own day; an item's vector changes with the day."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    days = spark.range(3).select(F.col("id").alias("day"))
    items = towers.as_of(e.withColumnRenamed("vec_id", "item_id"), days, "day", {"v": F.transform("v", lambda x: x * (1 + F.col("day") * (F.col("item_id") % 7) / 10.0))})
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), (F.floor(F.col("vec_id") / 100) % 3).alias("day"), F.col("v").alias("q"))
    return retrieval.exact_top_k(queries, items, 10, 6, version="day").select("query_id", "item_id", "rank")


# ---- towers

NEGATIVES = 8
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FEATURES = ["hour", "log_hist_len", "t1_imp", "t1_rate", "balance", *[f"segment{k}" for k in range(len(SEGMENTS))]]
SIDE = ["log_freq", "age"]
GROUPS = 5


def structured(log: DataFrame) -> DataFrame:
    """The part of the log in which a user sees items of the own group only, so that a history tells what comes next."""
    return log.where((F.col("user_id") + F.col("video_id")) % GROUPS == 0)


@query()
def towers_by_day(spark, sf):
    """Recall of towers on data with structure, item vectors as of each request's day, beside chance (no SQL: training).

    The user tower sees the history, the hour, features of the days before, and static numbers and categories; the item
    tower the item, its frequency and its age on the day.
    """
    log = structured(_log(spark, sf)).where("video_id IS NOT NULL")
    start = F.lit("2023-12-01").cast("date")
    items = retrieval.catalog(log.where("split IN ('warmup', 'train')"), 1).withColumn("log_freq", F.log1p("train_freq") / 5).withColumn("upload", F.date_add(start, (F.col("video_id") % 30).cast("int")))
    states = log.select("user_id", "time_ms", "video_id").distinct()
    prior = windows.priors(log, ["is_click"])
    rolled = windows.rolling(log, ["user_id"], "video_id", ["is_click"], ["is_click"], [7], prior, "u").select("user_id", "date", "u_imp_7d", "u_is_click_smooth_7d")
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") / 10_000).alias("balance"), *[(F.col("c_mktsegment") == s).cast("double").alias(f"segment{k}") for k, s in enumerate(SEGMENTS)])

    def ready(rows: DataFrame) -> DataFrame:
        kept = rows.join(items.select("video_id"), "video_id", "left_semi")
        with_hist = kept.join(history.strict_history(kept, states, n=20), ["user_id", "time_ms"])
        whole = with_hist.join(rolled, ["user_id", "date"], "left").join(users, "user_id", "left").crossJoin(F.broadcast(prior))
        t1 = [(F.log1p(F.coalesce("u_imp_7d", F.lit(0))) / 3).alias("t1_imp"), F.coalesce("u_is_click_smooth_7d", "g_is_click").alias("t1_rate")]
        return whole.select(F.col("event_id").alias("row_id"), "user_id", "time_ms", "date", "video_id", "hist", (F.floor(F.col("hourmin") / 100) / 24).alias("hour"), (F.log1p("hist_len") / 3).alias("log_hist_len"), *t1, "balance", *FEATURES[5:])

    train, test = ready(log.where("split = 'train'")), ready(log.where("split = 'test'"))
    aged = {"age": F.log1p(F.greatest(F.datediff(windows.as_date("date"), "upload"), F.lit(0)).cast("double")) / 4}
    numbers = order.numbered(items.select("video_id"), [F.col("video_id")], "_i")
    drawn = retrieval.random_negatives(train, "row_id", NEGATIVES, 1, items.count())
    negatives = drawn.withColumnRenamed("negative", "_i").join(numbers, "_i").select("row_id", "slot", F.col("video_id").alias("negative"))
    middle = train.agg(F.floor((F.min("date") + F.max("date")) / 2).cast("int")).first()[0]
    fixed = items.withColumn("date", F.lit(middle)).withColumns(aged).withColumn("log_q", F.lit(0.0))
    net, _ = towers.fit(train, negatives, fixed, towers.Towers(len(FEATURES), len(SIDE)), FEATURES, SIDE, steps=40, rate=0.1)
    asked = test.groupBy("user_id", "time_ms", "date").agg(F.min_by(F.struct("row_id", "hist", *FEATURES), "row_id").alias("r"), F.collect_set("video_id").alias("targets")).select("r.*", "date", "targets")
    users = towers.user_vectors(asked, net, FEATURES).join(asked.select(F.col("row_id").alias("query_id"), "date"), "query_id")
    vectors = towers.item_vectors(towers.as_of(items, asked, "date", aged), net, SIDE, carry=["date"])
    top = retrieval.exact_top_k(users, vectors, 20, version="date")
    wanted = asked.select("row_id", F.size("targets").alias("n_targets"), F.explode("targets").alias("item_id"))
    hits = wanted.join(top.select(F.col("query_id").alias("row_id"), "item_id", "rank"), ["row_id", "item_id"], "left")
    per = metrics.ranking_at(hits, ["row_id"], [10, 20])
    out = per.groupBy("k").agg(F.count("*").alias("requests"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "hitrate", "ndcg")])
    return out.join(metrics.lift_over_chance(per, items).select("k", F.round("chance", 6).alias("chance"), F.round("lift", 3).alias("lift")), "k")
