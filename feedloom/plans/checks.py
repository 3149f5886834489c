"""Queries: samplers by name, sampled loss with log q, history lengths, pools within a catalog, catalog and source checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import experiments, guards, history, retrieval, samplers, selection
from feedloom.plans.common import EV, query
from feedloom.plans.retrieval import _draw
from feedloom.views import log_events, table, with_split

_TRAIN = "split IN ('warmup', 'train')"


def _log(spark, sf):
    return with_split(log_events(spark, sf))


@query(f"""WITH {EV}, s AS (SELECT event_id, user_id, video_id, event_id // 64 AS batch FROM lg WHERE split = 'train' AND is_click = 1 AND video_id IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS size FROM s),
pool AS (SELECT user_id, video_id FROM lg WHERE {_TRAIN} AND video_id IS NOT NULL GROUP BY 1, 2 HAVING max(is_click) = 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY video_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS size FROM pool), z AS (SELECT user_id, any_value(size) AS size FROM n GROUP BY 1),
rnd AS (SELECT event_id, video_id AS target, {_draw('event_id', 'slot')} % 100 AS negative FROM s, range(0, 4) r(slot)), inb AS (SELECT a.event_id, a.video_id AS target, b.video_id AS negative FROM b a, range(0, 4) r(slot), b WHERE b.batch = a.batch AND b.pos = {_draw('a.event_id', 'slot')} % a.size),
ful AS (SELECT a.event_id, a.video_id AS target, b.video_id AS negative FROM b a JOIN b ON a.batch = b.batch AND a.event_id <> b.event_id),
ex AS (SELECT s.event_id, s.video_id AS target, coalesce(n.video_id, {_draw('s.event_id', 'slot')} % 100) AS negative FROM s CROSS JOIN range(0, 4) r(slot) LEFT JOIN z ON z.user_id = s.user_id LEFT JOIN n ON n.user_id = s.user_id AND n.pos = {_draw('s.event_id', 'slot')} % z.size),
hy AS (SELECT event_id, video_id AS target, {_draw('event_id', 'slot')} % 100 AS negative FROM s, range(0, 2) r(slot) UNION ALL SELECT s.event_id, s.video_id, coalesce(n.video_id, {_draw('s.event_id', 'slot').replace("'42|'", "'43|'")} % 100) FROM s CROSS JOIN range(0, 2) r(slot) LEFT JOIN z ON z.user_id = s.user_id LEFT JOIN n ON n.user_id = s.user_id AND n.pos = {_draw('s.event_id', 'slot').replace("'42|'", "'43|'")} % z.size),
u AS (SELECT 'random' AS strategy, false AS log_q, * FROM rnd UNION ALL SELECT 'inbatch', false, * FROM inb UNION ALL SELECT 'inbatch_logq', true, * FROM inb UNION ALL SELECT 'inbatch_full_logq', true, * FROM ful UNION ALL SELECT 'exposure', false, * FROM ex UNION ALL SELECT 'hybrid', false, * FROM hy)
SELECT strategy, log_q, count(*) AS drawn, CAST(sum(negative) AS BIGINT) AS total, count(*) FILTER (negative = target) AS hits, count(DISTINCT negative) AS items FROM u GROUP BY 1, 2""")
def sampler_draws(spark, sf):
    """What each of the six strategies draws for the training clicks: draws, their sum, accidental hits, distinct items."""
    log = _log(spark, sf).where("video_id IS NOT NULL")
    rows = log.where("split = 'train' AND is_click = 1").select("event_id", "user_id", "video_id", F.floor(F.col("event_id") / 64).alias("batch"))
    pool, out = retrieval.exposure_pool(log.where(_TRAIN), ["is_click"]), None
    for name in samplers.STRATEGIES:
        drawn = samplers.negatives(name, rows, "event_id", "video_id", 4, 0, 99, pool=pool).join(rows.select("event_id", F.col("video_id").alias("target")), "event_id")
        one = drawn.agg(F.count("*").alias("drawn"), F.sum("negative").cast("long").alias("total"), F.count_if(F.col("negative") == F.col("target")).alias("hits"), F.count_distinct("negative").alias("items"))
        one = one.select(F.lit(name).alias("strategy"), F.lit(name in samplers.USES_LOG_Q).alias("log_q"), "drawn", "total", "hits", "items")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH q AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS log_q FROM embeddings GROUP BY label), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, vec_id // 16 AS batch, log_q, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY vec_id // 16) AS size FROM embeddings JOIN q USING (label)),
s AS (SELECT vec_id AS row_id, true AS own, list_dot_product(v, v) / 0.5 - log_q AS z FROM e UNION ALL SELECT a.vec_id, false, list_dot_product(a.v, b.v) / 0.5 - b.log_q FROM e a, range(0, 5) r(slot), e b WHERE b.batch = a.batch AND b.pos = {_draw('a.vec_id', 'slot')} % a.size AND b.label <> a.label), m AS (SELECT *, max(z) OVER (PARTITION BY row_id) AS top FROM s)
SELECT row_id, round(any_value(top) + ln(sum(exp(z - top))) - sum(CASE WHEN own THEN z ELSE 0 END), 6) AS loss, round((any_value(top) + ln(sum(exp(z - top))) - sum(CASE WHEN own THEN z ELSE 0 END)) / ln(6), 6) AS share FROM m GROUP BY row_id""")
def sampled_loss_logq(spark, sf):
    """Sampled loss with log q off every logit, accidental hits masked, and its share of ln(candidates)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding", F.floor(F.col("vec_id") / 16).alias("batch"))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    q = n.crossJoin(total).select("label", F.log(F.col("n") / F.col("total")).alias("log_q"))
    drawn = samplers.negatives("inbatch_logq", e, "row_id", "row_id", 5, 0, 0)
    asked = drawn.select("row_id", F.col("negative").alias("other"), F.lit(0).alias("is_positive")).unionByName(e.select("row_id", F.col("row_id").alias("other"), F.lit(1).alias("is_positive")))
    own = e.select("row_id", F.col("label").alias("la"), F.col("embedding").alias("a"))
    theirs = e.select(F.col("row_id").alias("other"), "label", F.col("embedding").alias("b"))
    scores = asked.join(own, "row_id").join(theirs, "other").select("row_id", "is_positive", "label", retrieval.dot("a", "b").alias("score"), ((F.col("is_positive") == 0) & (F.col("la") == F.col("label"))).alias("hit"))
    loss = retrieval.sampled_softmax(samplers.with_log_q(scores, "inbatch_logq", q, "label", 0.5), "row_id", 0.5)
    return loss.select("row_id", F.round("loss", 6).alias("loss"), F.round(samplers.normalised("loss", 6), 6).alias("share"))


@query(f"""WITH {EV}, m AS (SELECT DISTINCT user_id, time_ms, split FROM lg WHERE split <> 'unused'), p AS (SELECT DISTINCT user_id, time_ms, video_id FROM lg WHERE (is_click = 1 OR long_view = 1) AND video_id IS NOT NULL),
h AS (SELECT m.user_id, m.time_ms, m.split, least(count(p.video_id), 20) AS n FROM m LEFT JOIN p ON p.user_id = m.user_id AND p.time_ms < m.time_ms GROUP BY ALL)
SELECT split, count(*) AS moments, round(avg(n), 6) AS mean_len, median(n) AS median_len, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS empty_share, round(avg(CASE WHEN n = 20 THEN 1.0 ELSE 0.0 END), 6) AS full_share FROM h GROUP BY split""")
def history_lengths(spark, sf):
    """Mean and exact median length of histories of up to 20, and the shares of empty and full ones, by split."""
    log = _log(spark, sf).where("split <> 'unused'")
    positives = log.where(retrieval.positive(["is_click", "long_view"]) & F.col("video_id").isNotNull()).select("user_id", "time_ms", "video_id").distinct()
    moments = log.select("user_id", "time_ms", "split").distinct()
    sized = moments.join(history.strict_history(moments, positives, n=20).select("user_id", "time_ms", "hist_len"), ["user_id", "time_ms"])
    splits = ["warmup", "train", "valid", "test"]
    middle = selection.medians(sized.select(*[F.when(F.col("split") == s, F.col("hist_len")).alias(s) for s in splits]), splits)
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = sized.groupBy("split").agg(F.count("*").alias("moments"), F.round(F.avg("hist_len"), 6).alias("mean_len"), share(F.col("hist_len") == 0).alias("empty_share"), share(F.col("hist_len") == 20).alias("full_share"))
    known = F.element_at(F.create_map(*[F.lit(x) for s in splits for x in (s, float(middle[s] or 0))]), F.col("split"))
    return out.withColumn("median_len", known)


@query(f"""WITH {EV}, c AS (SELECT video_id FROM lg WHERE {_TRAIN} AND video_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 60), x AS (SELECT user_id, video_id, max(is_click) AS pos FROM lg SEMI JOIN c USING (video_id) WHERE {_TRAIN} GROUP BY 1, 2),
n AS (SELECT u.user_id, count(x.video_id) FILTER (x.pos = 0) AS n, count(x.video_id) AS shown FROM (SELECT DISTINCT user_id FROM lg) u LEFT JOIN x USING (user_id) GROUP BY 1)
SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(shown) AS BIGINT) AS exposed_pairs, count(*) FILTER (n = 0) AS empty_users, min(n) AS min_n, CAST(floor(median(n)) AS BIGINT) AS p50_n, max(n) AS max_n FROM n""")
def exposure_pool_in_catalog(spark, sf):
    """Pools of shown and never clicked items, those of the catalog only, beside all exposed pairs of the catalog."""
    log = _log(spark, sf)
    cat = retrieval.catalog(log.where(_TRAIN).where("video_id IS NOT NULL"), 60)
    shown = log.where(_TRAIN).join(cat.select("video_id"), "video_id", "left_semi")
    pool = retrieval.exposure_pool(shown, ["is_click"])
    users = log.select("user_id").distinct()
    sizes = users.join(pool.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    middle = selection.medians(sizes, ["n"])["n"] or 0.0
    exposed = shown.select("user_id", "video_id").distinct().agg(F.count("*").alias("exposed_pairs"))
    stats = sizes.agg(F.count("*").alias("users"), F.sum("n").alias("pairs"), F.count_if(F.col("n") == 0).alias("empty_users"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    return stats.crossJoin(exposed).select("users", "pairs", "exposed_pairs", "empty_users", "min_n", F.lit(int(middle)).cast("long").alias("p50_n"), "max_n")


@query("SELECT * FROM (VALUES ('catalog_repeats', CAST(0 AS BIGINT)), ('answers_outside', CAST(0 AS BIGINT)), ('bands_uncovered', CAST(0 AS BIGINT)), ('statistic', CAST(0 AS BIGINT)), ('random_4_22', CAST(0 AS BIGINT))) t(\"check\", violations)")
def catalog_and_source_checks(spark, sf):
    """Violations: items twice in the catalog, answers outside it, frequencies in no band, banned files among the sources."""
    log = _log(spark, sf)
    cat = retrieval.catalog(log.where(_TRAIN).where("video_id IS NOT NULL"), 5)
    answers = log.where("split = 'test'").where(retrieval.positive(["is_click", "long_view"])).join(cat.select("video_id"), "video_id", "left_semi").select("video_id")
    band = F.when((F.col("train_freq") >= 5) & (F.col("train_freq") < 10), "tail").when((F.col("train_freq") >= 10) & (F.col("train_freq") < 30), "mid").when(F.col("train_freq") >= 30, "warm")
    uncovered = guards.checks(cat, {"bands_uncovered": band.isNull()})
    files = table(spark, sf, "events").select(F.input_file_name().alias("path")).distinct()
    return guards.union(guards.repeated(cat, ["video_id"], "catalog_repeats"), guards.not_within(answers, cat, ["video_id"], "answers_outside"), uncovered, experiments.banned_sources(files, ["statistic", "random_4_22"]))
