"""Queries: tag preference, category diversity, upload-date protocol, ranking item table, multi-task and boosted ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import encoding, metrics, multitask, rerank, windows
from feedloom.plans.common import EV, OR, once, query
from feedloom.views import LABELS, log_events, log_orders, table, with_split


def _log(spark, sf):
    return with_split(log_events(spark, sf))


@query(f"""WITH {EV}, t AS (SELECT DISTINCT p_partkey, tag FROM (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS tag FROM part) WHERE tag <> ''), x AS (SELECT user_id, tag, day, is_click FROM lg JOIN t ON p_partkey = video_id),
d AS (SELECT DISTINCT user_id, tag, CAST(day + CAST(o AS INT) AS DATE) AS target FROM x, range(1, 8) r(o)), g AS (SELECT avg(is_click) AS g FROM lg WHERE split = 'warmup')
SELECT d.user_id, d.tag, CAST(strftime(d.target, '%Y%m%d') AS INT) AS date, count(*) AS imp_7d, CAST(sum(is_click) AS BIGINT) AS click_7d, round((sum(is_click) + 20 * any_value(g)) / (count(*) + 20), 9) AS pref_7d
FROM d JOIN x ON x.user_id = d.user_id AND x.tag = d.tag AND x.day BETWEEN d.target - 7 AND d.target - 1, g WHERE d.target <= DATE '2024-01-30' GROUP BY 1, 2, 3""")
def tag_preference(spark, sf):
    """Smoothed click rate of user and tag over the seven days before each target day."""
    log = _log(spark, sf)
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), F.explode(F.array_distinct(encoding.tags("p_name", True, " "))).alias("tag"))
    days = windows.project(windows.daily(log.join(tags, "video_id"), ["user_id", "tag"], ["is_click"]), 7).where("target <= 20240130")
    sums = days.groupBy("user_id", "tag", F.col("target").alias("date")).agg(F.sum("imp").alias("imp_7d"), F.sum("is_click").alias("click_7d"))
    smooth = (F.col("click_7d") + windows.ALPHA * F.col("g_is_click")) / (F.col("imp_7d") + windows.ALPHA)
    return sums.crossJoin(F.broadcast(windows.priors(log, ["is_click"]))).select("user_id", "tag", "date", "imp_7d", "click_7d", F.round(smooth, 9).alias("pref_7d"))


@query(f"""WITH {OR}, s AS (SELECT user_id, video_id, count(*) + 0.5 * sum(positive) AS score FROM lo GROUP BY 1, 2), a AS (SELECT s.*, p_brand AS category, row_number() OVER (PARTITION BY user_id, p_brand ORDER BY score DESC, video_id) AS k FROM s JOIN part ON p_partkey = video_id),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, video_id) AS rank FROM a WHERE k <= 2) SELECT user_id, video_id, category, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM t WHERE rank <= 10""")
def category_diversity(spark, sf):
    """Lists by a fused score with at most two items of a category."""
    seen = log_orders(spark, sf).groupBy("user_id", "video_id").agg(F.count("*").alias("n"), F.sum("positive").alias("pos"))
    scored = seen.withColumn("score", rerank.fuse({"n": 1.0, "pos": 0.5}))
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_brand").alias("category"))
    return rerank.diverse(scored.join(kinds, "video_id"), ["user_id"], "category", 2, 10).select("user_id", "video_id", "category", "score", "rank")


@query(f"""WITH {OR}, u AS (SELECT p_partkey AS video_id, DATE '1995-01-01' + 30 * p_size AS upload FROM part), r AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, video_id FROM lo WHERE positive = 1), c AS (SELECT day, (SELECT count(*) FROM u WHERE upload < day) AS n FROM (SELECT DISTINCT day FROM r))
SELECT CAST(year(r.day) AS INT) AS year, count(*) AS requests, count(*) FILTER (upload < r.day) AS eligible, round(avg(c.n) FILTER (upload < r.day), 6) AS mean_candidates FROM r JOIN u USING (video_id) JOIN c ON c.day = r.day GROUP BY 1""")
def upload_protocol(spark, sf):
    """Requests whose target was uploaded before the request's day, and how many items then were.

    Uploads are summed by day first; the join by order of days is of days with days, bounded by the calendar.
    """
    u = table(spark, sf, "part").select(F.col("p_partkey").alias("video_id"), F.date_add(F.lit("1995-01-01").cast("date"), (30 * F.col("p_size")).cast("int")).alias("upload"))
    r = log_orders(spark, sf).where("positive = 1").select("user_id", F.col("ts").cast("date").alias("day"), "video_id").distinct()
    sizes = r.select("day").distinct().join(u.groupBy("upload").agg(F.count("*").alias("m")), F.col("upload") < F.col("day")).groupBy("day").agg(F.sum("m").alias("n"))
    at = r.join(u, "video_id").join(sizes, "day", "left").withColumn("ok", F.col("upload") < F.col("day"))
    return at.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("requests"), F.sum(F.col("ok").cast("long")).alias("eligible"), F.round(F.avg(F.when(F.col("ok"), F.col("n"))), 6).alias("mean_candidates"))


@query(f"""WITH {OR}, v AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) + 1 AS idx FROM (SELECT video_id AS id, count(*) AS n FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 20)),
t AS (SELECT p_partkey, pos, tag FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) WHERE tag <> ''),
x AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) + 1 AS idx FROM t GROUP BY 1), g AS (SELECT p_partkey, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS tags, count(*) AS n FROM t JOIN x USING (tag) GROUP BY 1)
SELECT p.p_partkey AS video_id, CAST(coalesce(v.idx, 1) AS INT) AS video_rank_idx, coalesce(g.tags, '') AS tag_rank_idx, CAST(coalesce(g.n, 0) AS INT) AS n_tags, CAST(coalesce(p_size, 0) AS INT) AS duration_ms,
CAST(v.idx IS NOT NULL AS INT) AS video_known, CAST(g.n IS NOT NULL AS INT) AS tag_known, CAST(p_size IS NOT NULL AS INT) AS duration_known FROM part p LEFT JOIN v ON v.id = p.p_partkey LEFT JOIN g ON g.p_partkey = p.p_partkey""")
def item_static_rank(spark, sf):
    """Ranking's item table: tags keep their order and repeats, none gives an empty list; flags say what is known."""
    part = table(spark, sf, "part")
    video = encoding.vocabulary(log_orders(spark, sf).where("year <= 1998").groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 20"))
    tags = part.select("p_partkey", F.posexplode(encoding.tags("p_name", False, " ")).alias("pos", "id"))
    kinds = encoding.vocabulary(tags.groupBy("id").agg(F.count("*").alias("n")))
    placed = tags.join(kinds.select("id", "index"), "id").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("pos", "index"))).alias("_t"))
    j = part.join(video.select(F.col("id").alias("p_partkey"), F.col("index").alias("_v")), "p_partkey", "left").join(placed, "p_partkey", "left")
    listed = F.array_join(F.transform(F.col("_t"), lambda x: x["index"].cast("string")), ",")
    known = [F.col(c).isNotNull().cast("int").alias(f"{name}_known") for name, c in (("video", "_v"), ("tag", "_t"), ("duration", "p_size"))]
    return j.select(F.col("p_partkey").alias("video_id"), F.coalesce("_v", F.lit(1)).alias("video_rank_idx"), F.coalesce(listed, F.lit("")).alias("tag_rank_idx"), F.coalesce(F.size("_t") * F.col("_t").isNotNull().cast("int"), F.lit(0)).alias("n_tags"), F.coalesce(F.col("p_size").cast("int"), F.lit(0)).alias("duration_ms"), *known)


FEATURES = ["f_hour", "f_value", *[f"f_tab{k}" for k in range(5)], "f_one"]


def _ranking_rows(spark, sf):
    tabs = [(F.col("tab") == k).cast("double").alias(f"f_tab{k}") for k in range(5)]
    return _log(spark, sf).select("event_id", "user_id", "split", *LABELS, (F.floor(F.col("hourmin") / 100) / 24).alias("f_hour"), F.log1p(F.greatest("value", F.lit(0))).alias("f_value"), *tabs, F.lit(1.0).alias("f_one"))


@query()
def multitask_auc(spark, sf):
    """AUC on test of every task for models trained on the training split, single-task to PLE and selective sharing (no SQL: training)."""
    # every step waits for its largest part, so rows are dealt evenly once, whatever files the log lies in
    rows, n, out = once(_ranking_rows(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism, "event_id")), len(LABELS), None
    truth = F.coalesce(*[F.when(F.col("task") == c, F.col(c)) for c in LABELS])
    stacked, selective = multitask.Stacked(len(FEATURES), n), multitask.Selective(len(FEATURES), n)
    for name, model in (("single", multitask.single(n)), ("mmoe", multitask.mmoe(n, 4)), ("cgc", multitask.cgc(n, 2)), ("ple", stacked), ("selective", selective)):
        net, _ = multitask.fit(rows.where("split = 'train'"), FEATURES, list(LABELS), model)
        p = multitask.predict(rows.where("split = 'test'"), net, FEATURES, list(LABELS), list(LABELS))
        one = p.select(F.lit(name).alias("model"), "task", "p", truth.alias("y"))
        out = one if out is None else out.unionByName(one)
    return metrics.auc(out, ["model", "task"]).select("model", "task", "n", "pos", F.round("auc", 4).alias("auc"))


@query()
def prerank_boosted(spark, sf):
    """AUC on test of boosted trees for clicks, trained on the training split (no SQL: training)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep").transform(_ranking_rows(spark, sf))
    model = GBTClassifier(featuresCol="x", labelCol="is_click", maxIter=5, maxDepth=3, seed=42).fit(rows.where("split = 'train'"))
    p = model.transform(rows.where("split = 'test'")).select(vector_to_array("probability")[1].alias("p"), F.col("is_click").alias("y"), F.lit("is_click").alias("task"))
    return metrics.auc(p, ["task"]).select("task", "n", "pos", F.round("auc", 4).alias("auc"))
