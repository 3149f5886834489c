"""Queries: hybrid negatives, lifts, frequency bands over seeds, dispersion, checks of predictions, vocabulary coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import encoding, metrics, retrieval
from feedloom.plans.common import EV, OR, ORACLE_SQL, once, query
from feedloom.plans.evaluation import _PRED, _pred
from feedloom.plans.retrieval import _BASE, _POS, _TRAIN, _draw, _log, _popular_hits, order_log, padded_answers
from feedloom.views import table


@query(f"""WITH {EV}, pool AS (SELECT user_id, video_id FROM lg WHERE {_TRAIN} GROUP BY 1, 2 HAVING max(is_click) = 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY video_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS size FROM pool), z AS (SELECT user_id, any_value(size) AS size FROM n GROUP BY 1),
s AS (SELECT event_id, user_id FROM lg WHERE split = 'train' AND is_click = 1), x AS (SELECT s.event_id, s.user_id, slot, {_draw('event_id', 'slot').replace('42|', '43|')} AS d, z.size FROM s CROSS JOIN range(0, 2) r(slot) LEFT JOIN z ON z.user_id = s.user_id)
SELECT event_id, CAST(slot AS INT) AS slot, {_draw('event_id', 'slot')} % 100 AS negative, 'random' AS kind FROM s, range(0, 3) r(slot)
UNION ALL SELECT x.event_id, CAST(x.slot + 3 AS INT), coalesce(n.video_id, d % 100), CASE WHEN n.video_id IS NULL THEN 'fallback' ELSE 'exposure' END FROM x LEFT JOIN n ON n.user_id = x.user_id AND n.pos = d % x.size""")
def hybrid_negatives(spark, sf):
    """Three random items and two of the user's own pool for each clicked row."""
    log = _log(spark, sf)
    pool = retrieval.exposure_pool(log.where(_TRAIN), ["is_click"])
    return retrieval.hybrid_negatives(log.where("split = 'train' AND is_click = 1"), pool, "event_id", 5, 0.4, 0, 99)


@query(f"""WITH {EV}, c AS (SELECT video_id FROM lg WHERE {_TRAIN} GROUP BY 1 HAVING count(*) >= 5), p AS (SELECT video_id, count(*) AS n FROM lg SEMI JOIN c USING (video_id) WHERE {_TRAIN} AND (is_click = 1 OR long_view = 1) GROUP BY 1),
q AS (SELECT n / sum(n) OVER () * (SELECT count(*) FROM c) AS qn FROM p) SELECT (SELECT count(*) FROM c) AS items, count(*) AS supported, round(count(*) / (SELECT count(*) FROM c), 9) AS coverage, round(min(qn), 9) AS min_qn, round(median(qn), 9) AS p50_qn, round(max(qn), 9) AS max_qn FROM q""")
def log_q_stats(spark, sf):
    train = _log(spark, sf).where(_TRAIN)
    cat = retrieval.catalog(train, 5)
    s = retrieval.log_q_stats(retrieval.log_q(train.where(retrieval.positive(_POS)).join(cat, "video_id", "left_semi")), cat)
    return s.select("items", "supported", *[F.round(c, 9).alias(c) for c in ("coverage", "min_qn", "p50_qn", "max_qn")])


@query(_BASE + " SELECT CAST(k AS INT) AS k, round(avg(recall), 9) AS recall, round(k / (SELECT count(*) FROM c), 9) AS chance, round(avg(recall) / (k / (SELECT count(*) FROM c)), 9) AS lift FROM q GROUP BY k")
def popularity_lift(spark, sf):
    """Recall of the popularity baseline against that of random items."""
    at = metrics.ranking_at(_popular_hits(spark, sf), ["event_id"], [5, 10, 50])
    m = metrics.lift_over_chance(at, retrieval.catalog(_log(spark, sf).where(_TRAIN), 5))
    return m.select("k", *[F.round(c, 9).alias(c) for c in ("recall", "chance", "lift")])


@query(_BASE + """, s AS (SELECT k, CASE WHEN train_freq < 10 THEN 'tail' WHEN train_freq < 30 THEN 'mid' ELSE 'warm' END AS band, user_id % 3 AS seed, avg(recall) AS m FROM q GROUP BY 1, 2, 3)
SELECT CAST(k AS INT) AS k, band, count(*) AS seeds, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS std FROM s GROUP BY 1, 2""")
def band_over_seeds(spark, sf):
    """Recall by the target's frequency band, mean and deviation over three groups of users that stand for seeds."""
    hits = _popular_hits(spark, sf).withColumn("band", metrics.frequency_band()).withColumn("seed", F.col("user_id") % 3)
    at = metrics.over_seeds(metrics.ranking_at(hits, ["event_id", "band", "seed"], [5, 10, 50]), ["k", "band"], "seed", "recall")
    return at.select("k", "band", "seeds", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query("""WITH m AS (SELECT pos, avg(x) AS x FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos), mv AS (SELECT list(x ORDER BY pos) AS u FROM m),
f AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT round_even(list_dot_product(u, CAST(embedding AS DOUBLE[])), 6) AS score, n FROM embeddings JOIN f ON id = vec_id, mv),
r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM s) SELECT round(corr(a, b), 9) AS rho FROM r""")
def global_component(spark, sf):
    """Rank correlation of items' frequency with their product with the mean query vector."""
    e = table(spark, sf, "embeddings")
    freq = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("vec_id")).agg(F.count("*").alias("n"))
    mean = retrieval.mean_vector(e, "embedding")
    s = e.join(freq, "vec_id").crossJoin(F.broadcast(mean)).select(F.bround(retrieval.dot("u", "embedding"), 6).alias("score"), "n")
    return metrics.spearman(s, "score", "n").select(F.round("rho", 9).alias("rho"))


@query(f"""WITH {EV}, v AS (SELECT 'm' || tab AS model, CAST(user_id % 3 AS INT) AS seed, unnest(['click', 'view']) AS metric, unnest([is_click, long_view]) AS x FROM lg), r AS (SELECT model, seed, metric, avg(x) AS value FROM v GROUP BY ALL),
d AS (SELECT a.model, a.metric, a.value - b.value AS d FROM r a JOIN r b ON a.seed = b.seed AND a.metric = b.metric AND b.model = 'm0' WHERE a.model <> 'm0'), s AS (SELECT model, metric, avg(d) AS m, stddev_samp(d) AS sd FROM d GROUP BY ALL)
SELECT a.metric, round(a.sd / nullif(b.sd, 0), 6) AS ratio, abs(a.m) >= 2 * a.sd AS clear_a, abs(b.m) >= 2 * b.sd AS clear_b FROM s a JOIN s b ON a.metric = b.metric WHERE a.model = 'm1' AND b.model = 'm2'""")
def delta_dispersion(spark, sf):
    """How far two models' differences to the baseline scatter over seeds, and whether their means stand out."""
    runs = _log(spark, sf).groupBy(F.concat(F.lit("m"), "tab").alias("model"), (F.col("user_id") % 3).cast("int").alias("seed")).agg(F.avg("is_click").alias("click"), F.avg("long_view").alias("view")).unpivot(["model", "seed"], ["click", "view"], "metric", "value")
    d = metrics.dispersion(metrics.paired_delta(runs, "m0"), "m1", "m2")
    return d.select("metric", F.round("ratio", 6).alias("ratio"), "clear_a", "clear_b")


@query(f"""WITH {EV}, {_PRED} SELECT 'label' AS "check", count(*) FILTER (y IS NULL OR y NOT IN (0, 1)) AS violations FROM pr
UNION ALL SELECT 'missing_score', count(*) FILTER (p IS NULL OR isnan(p)) FROM pr UNION ALL SELECT 'score_range', count(*) FILTER (p < 0 OR (p > 1 AND NOT isnan(p))) FROM pr""")
def prediction_checks(spark, sf):
    return metrics.prediction_checks(_pred(spark, sf))


@query(f"""WITH {EV}, v AS (SELECT video_id FROM lg WHERE {_TRAIN} GROUP BY 1 HAVING count(*) >= 5), a AS (SELECT author_id FROM lg WHERE {_TRAIN} GROUP BY 1 HAVING count(*) >= 30)
SELECT 'video' AS vocabulary, count(*) AS n, count(v.video_id) AS covered, round(count(v.video_id) / count(*), 9) AS coverage FROM lg LEFT JOIN v ON v.video_id = lg.video_id WHERE split = 'test'
UNION ALL SELECT 'author', count(*), count(a.author_id), round(count(a.author_id) / count(*), 9) FROM lg LEFT JOIN a ON a.author_id = lg.author_id WHERE split = 'test'""")
def vocab_coverage(spark, sf):
    """Share of the test rows whose video, or author, training has seen often enough."""
    log = _log(spark, sf)
    train, test, out = log.where(_TRAIN), log.where("split = 'test'"), None
    for name, col, least in (("video", "video_id", 5), ("author", "author_id", 30)):
        one = encoding.coverage(test, retrieval.catalog(train, least, col), col)
        row = one.select(F.lit(name).alias("vocabulary"), "n", "covered", F.round("coverage", 9).alias("coverage"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH top AS ({ORACLE_SQL["itemcf_padded_topk"]}), {OR}, c AS (SELECT video_id FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 20), t AS (SELECT DISTINCT user_id, ts, video_id FROM lo SEMI JOIN c USING (video_id) WHERE year = 2001 AND positive = 1),
n AS (SELECT user_id, ts, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT m, sum(1 / log2(r + 1)) AS ideal FROM range(1, 11) a(m), range(1, 11) b(r) WHERE r <= m GROUP BY m),
q AS (SELECT t.user_id, t.ts, k, any_value(n.n) AS n, count(*) FILTER (rank <= k) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg FROM t JOIN n ON n.user_id = t.user_id AND n.ts = t.ts LEFT JOIN top ON top.user_id = t.user_id AND top.ts = t.ts AND top.video_id = t.video_id, (VALUES (5), (10)) x(k) GROUP BY 1, 2, 3),
e AS (SELECT user_id, k, hits / n AS recall, CAST(hits > 0 AS DOUBLE) AS hitrate, dcg / ideal AS ndcg FROM q JOIN g ON m = least(n, k))
SELECT CAST(k AS INT) AS k, 'per_request' AS scheme, round(avg(recall), 9) AS recall, round(avg(hitrate), 9) AS hitrate, round(avg(ndcg), 9) AS ndcg FROM e GROUP BY k
UNION ALL SELECT k, 'per_user', round(avg(recall), 9), round(avg(hitrate), 9), round(avg(ndcg), 9) FROM (SELECT k, user_id, avg(recall) AS recall, avg(hitrate) AS hitrate, avg(ndcg) AS ndcg FROM e GROUP BY 1, 2) GROUP BY k""")
def itemcf_metrics(spark, sf):
    """Recall, hit rate and NDCG of item-to-item answers for moments with several targets each."""
    log = order_log(spark, sf)
    cat = retrieval.catalog(log.where("year <= 1998"), 20)
    asked = once(log.where("year = 2001 AND positive = 1").join(cat, "video_id", "left_semi").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "video_id").distinct())
    hits = asked.join(asked.groupBy("user_id", "ts").agg(F.count("*").alias("n_targets")), ["user_id", "ts"])
    hits = hits.join(padded_answers(log).select("user_id", "ts", "video_id", "rank"), ["user_id", "ts", "video_id"], "left")
    m = metrics.two_averages(metrics.ranking_at(hits, ["user_id", "ts"], [5, 10]), "user_id")
    return m.select("k", "scheme", *[F.round(c, 9).alias(c) for c in ("recall", "hitrate", "ndcg")])
