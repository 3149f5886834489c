"""Queries: catalogs, item-to-item cosine, exact top-k, negatives, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import history, metrics, retrieval
from feedloom.plans.common import EV, OR, once, query
from feedloom.views import log_events, log_orders, table, with_split

_TRAIN = "split IN ('warmup', 'train')"
_POS = ["is_click", "long_view"]


def _log(spark, sf):
    return with_split(log_events(spark, sf))


@query(f"WITH {EV} SELECT video_id, count(*) AS train_freq FROM lg WHERE {_TRAIN} GROUP BY 1 HAVING count(*) >= 5")
def catalog_main(spark, sf):
    return retrieval.catalog(_log(spark, sf).where(_TRAIN), 5)


@query(f"""WITH {OR}, c AS (SELECT video_id, count(*) AS n FROM lo WHERE year <= 1998 GROUP BY 1), r AS (SELECT DISTINCT user_id, ts, video_id FROM lo WHERE year > 1998 AND positive = 1)
SELECT protocol, (SELECT count(*) FROM c WHERE n >= k) AS items, (SELECT count(*) FROM r SEMI JOIN (SELECT video_id FROM c WHERE n >= k) x USING (video_id)) AS requests, round((SELECT count(*) FROM r SEMI JOIN (SELECT video_id FROM c WHERE n >= k) x USING (video_id)) / (SELECT count(*) FROM r), 9) AS coverage
FROM (VALUES ('main', 20), ('aux', 1)) p(protocol, k)""")
def catalog_protocols(spark, sf):
    log = log_orders(spark, sf)
    train, asked = log.where("year <= 1998"), log.where("year > 1998 AND positive = 1").select("user_id", "ts", "video_id").distinct()
    total = asked.agg(F.count("*").alias("total"))
    out = None
    for protocol, least in (("main", 20), ("aux", 1)):
        cat = retrieval.catalog(train, least)
        row = cat.agg(F.count("*").alias("items")).crossJoin(asked.join(cat, "video_id", "left_semi").agg(F.count("*").alias("requests"))).crossJoin(total)
        row = row.select(F.lit(protocol).alias("protocol"), "items", "requests", F.round(F.col("requests") / F.col("total"), 9).alias("coverage"))
        out = row if out is None else out.unionByName(row)
    return out


_BASE = f"""WITH {EV}, c AS (SELECT video_id, count(*) AS train_freq FROM lg WHERE {_TRAIN} GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT event_id, user_id, video_id FROM lg SEMI JOIN c USING (video_id) WHERE split = 'test' AND (is_click = 1 OR long_view = 1)),
pop AS (SELECT video_id, train_freq, row_number() OVER (ORDER BY train_freq DESC, video_id) AS rank FROM c),
q AS (SELECT r.user_id, r.event_id, k, CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END AS hitrate, CASE WHEN rank <= k THEN 1 / log2(rank + 1) ELSE 0.0 END AS ndcg, train_freq FROM r JOIN pop USING (video_id), (VALUES (5), (10), (50)) t(k))"""


def _popular_hits(spark, sf):
    log = _log(spark, sf)
    cat = retrieval.catalog(log.where(_TRAIN), 5)
    asked = log.where("split = 'test'").where(retrieval.positive(_POS)).join(cat, "video_id")
    return asked.join(retrieval.popular(cat, 50), "video_id", "left").select("event_id", "user_id", "train_freq", F.lit(1).alias("n_targets"), "rank")


@query(_BASE + """ SELECT CAST(k AS INT) AS k, 'per_request' AS scheme, round(avg(recall), 9) AS recall, round(avg(hitrate), 9) AS hitrate, round(avg(ndcg), 9) AS ndcg FROM q GROUP BY k
UNION ALL SELECT k, 'per_user', round(avg(recall), 9), round(avg(hitrate), 9), round(avg(ndcg), 9) FROM (SELECT k, user_id, avg(recall) AS recall, avg(hitrate) AS hitrate, avg(ndcg) AS ndcg FROM q GROUP BY 1, 2) GROUP BY k""")
def popularity_baseline(spark, sf):
    """Popularity top-k as the answer to every request: Recall, HitRate and NDCG."""
    m = metrics.two_averages(metrics.ranking_at(_popular_hits(spark, sf), ["event_id", "user_id"], [5, 10, 50]), "user_id")
    return m.select("k", "scheme", *[F.round(c, 9).alias(c) for c in ("recall", "hitrate", "ndcg")])


@query(_BASE + """ SELECT CAST(k AS INT) AS k, CASE WHEN train_freq < 10 THEN 'tail' WHEN train_freq < 30 THEN 'mid' ELSE 'warm' END AS band, count(*) AS n, round(avg(recall), 9) AS recall FROM q GROUP BY 1, 2""")
def recall_by_band(spark, sf):
    hits = _popular_hits(spark, sf).withColumn("band", metrics.frequency_band())
    return metrics.ranking_at(hits, ["event_id", "band"], [5, 10, 50]).groupBy("k", "band").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 9).alias("recall"))


_PAIRS = "p AS (SELECT DISTINCT user_id AS u, video_id AS i FROM lo WHERE positive = 1 AND year <= 1998)"


_IN_CATALOG = " WHERE j IN (SELECT video_id FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 20)"


def _cosine_sql(iuf: bool, k: int, within: str = "") -> str:
    w = "1 / ln(1 + count(*) OVER (PARTITION BY u))" if iuf else "1.0"
    return f"""WITH {OR}, {_PAIRS}, w AS (SELECT u, i, {w} AS w FROM p), n AS (SELECT i, sqrt(sum(w)) AS norm FROM w GROUP BY i),
s AS (SELECT a.i, b.i AS j, round_even(sum(a.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS sim FROM w a JOIN w b ON a.u = b.u AND a.i <> b.i JOIN n x ON x.i = a.i JOIN n y ON y.i = b.i GROUP BY a.i, b.i),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM s{within})"""


def _pairs(log):
    return log.where("positive = 1 AND year <= 1998").select("user_id", "video_id").distinct()


@query(_cosine_sql(False, 10) + " SELECT i, j, sim, CAST(rank AS INT) AS rank FROM t WHERE rank <= 10")
def itemcf_cosine(spark, sf):
    return retrieval.item_cosine(_pairs(log_orders(spark, sf)), 10, places=6).select("i", "j", "sim", "rank")


@query(_cosine_sql(True, 5) + " SELECT i, j, sim, CAST(rank AS INT) AS rank FROM t WHERE rank <= 5")
def itemcf_iuf(spark, sf):
    return retrieval.item_cosine(_pairs(log_orders(spark, sf)), 5, iuf=True, places=6).select("i", "j", "sim", "rank")


def _moments(log):
    return log.where("year = 2001 AND positive = 1").select("user_id", "ts").distinct()


def order_log(spark, sf):
    """The order log's columns that item neighbours need, joined once."""
    return once(log_orders(spark, sf).select("user_id", "video_id", "ts", "positive", "year"))


def padded_answers(log):
    """Ten items for each moment of ``log`` by summed similarity to the strict history, padded from the catalog."""
    moments, cat = _moments(log), once(retrieval.catalog(log.where("year <= 1998"), 20))
    sims = retrieval.item_cosine(_pairs(log), 100, places=6, candidates=cat)
    scores = retrieval.cosine_scores(history.all_before(moments, log.where("positive = 1"), "user_id", "ts"), sims, ["user_id", "ts"], places=6)
    top = retrieval.padded_top_k(scores, moments, cat, ["user_id", "ts"], 10, within=True)
    return top.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "video_id", "score", "padded", "rank")


@query(_cosine_sql(False, 100, _IN_CATALOG) + """, m AS (SELECT DISTINCT user_id, ts FROM lo WHERE year = 2001 AND positive = 1), h AS (SELECT DISTINCT m.user_id, m.ts, lo.video_id AS i FROM m JOIN lo ON lo.user_id = m.user_id AND lo.ts < m.ts AND lo.positive = 1),
sc AS (SELECT h.user_id, h.ts, t.j, round_even(sum(t.sim), 6) AS score FROM h JOIN t ON t.i = h.i AND t.rank <= 100 GROUP BY ALL), c AS (SELECT video_id FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT m.user_id, m.ts, c.video_id, coalesce(sc.score, 0.0) AS score, CASE WHEN sc.score > 0 THEN 0 ELSE 1 END AS padded FROM m CROSS JOIN c LEFT JOIN sc ON sc.user_id = m.user_id AND sc.ts = m.ts AND sc.j = c.video_id),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY padded, score DESC, video_id) AS rank FROM f) SELECT user_id, ts, video_id, score, padded, CAST(rank AS INT) AS rank FROM z WHERE rank <= 10""")
def itemcf_padded_topk(spark, sf):
    """Top-k by summed similarity to the strict history, padded from the catalog."""
    return padded_answers(order_log(spark, sf))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS item_id, round_even(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, score, CAST(rank AS INT) AS rank FROM t WHERE rank <= 10""")
def exact_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    top = retrieval.exact_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 10)
    return top.select("query_id", "item_id", "score", "rank")


@query(f"WITH {OR} SELECT user_id, video_id FROM lo WHERE year <= 1998 GROUP BY 1, 2 HAVING max(positive) = 0")
def exposure_pool(spark, sf):
    return retrieval.exposure_pool(log_orders(spark, sf).where("year <= 1998"), ["positive"])


@query(f"""WITH {OR}, pool AS (SELECT user_id, video_id FROM lo WHERE year <= 1998 GROUP BY 1, 2 HAVING max(positive) = 0), n AS (SELECT u.user_id, count(pool.video_id) AS n FROM (SELECT DISTINCT user_id FROM lo) u LEFT JOIN pool USING (user_id) GROUP BY 1)
SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS pairs, count(*) FILTER (n = 0) AS empty_users, min(n) AS min_n, CAST(floor(median(n)) AS BIGINT) AS p50_n, max(n) AS max_n FROM n""")
def exposure_pool_stats(spark, sf):
    log = log_orders(spark, sf)
    return retrieval.pool_stats(retrieval.exposure_pool(log.where("year <= 1998"), ["positive"]), log)


def _draw(*keys: str) -> str:
    return "('0x' || substr(md5('42|' || " + " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "), 1, 8))::BIGINT"


@query(f"WITH {EV} SELECT event_id, CAST(slot AS INT) AS slot, 2 + {_draw('event_id', 'slot')} % 100 AS negative FROM lg, range(0, 5) r(slot) WHERE split = 'train' AND is_click = 1")
def random_negatives(spark, sf):
    return retrieval.random_negatives(_log(spark, sf).where("split = 'train' AND is_click = 1"), "event_id", 5, 2, 101)


@query(f"""WITH {EV}, b AS (SELECT event_id, event_id // 64 AS batch, video_id, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_id // 64) AS size FROM lg)
SELECT a.event_id, CAST(slot AS INT) AS slot, b.video_id AS negative FROM b a, range(0, 3) r(slot), b WHERE b.batch = a.batch AND b.pos = {_draw('a.event_id', 'slot')} % a.size""")
def inbatch_negatives(spark, sf):
    rows = _log(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 64))
    return retrieval.inbatch_negatives(rows, "event_id", "batch", "video_id", 3)


_XNEG = f"""WITH {EV}, pool AS (SELECT user_id, video_id FROM lg WHERE {_TRAIN} GROUP BY 1, 2 HAVING max(is_click) = 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY video_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS size FROM pool), z AS (SELECT user_id, any_value(size) AS size FROM n GROUP BY 1),
x AS (SELECT s.event_id, s.user_id, slot, {_draw('event_id', 'slot')} AS d, z.size FROM lg s CROSS JOIN range(0, 3) r(slot) LEFT JOIN z ON z.user_id = s.user_id WHERE split = 'train' AND is_click = 1)"""


@query(_XNEG + " SELECT x.event_id, x.user_id, CAST(slot AS INT) AS slot, coalesce(n.video_id, d % 100) AS negative, CAST(n.video_id IS NULL AS INT) AS fallback FROM x LEFT JOIN n ON n.user_id = x.user_id AND n.pos = d % x.size")
def exposure_negatives(spark, sf):
    log = _log(spark, sf)
    pool = retrieval.exposure_pool(log.where(_TRAIN), ["is_click"])
    return retrieval.exposure_negatives(log.where("split = 'train' AND is_click = 1"), pool, "event_id", 3, 0, 99)


@query(f"WITH {EV}, c AS (SELECT video_id, count(*) AS n FROM lg WHERE {_TRAIN} AND (is_click = 1 OR long_view = 1) GROUP BY 1) SELECT video_id, n, round(n / sum(n) OVER (), 9) AS q, round(ln(n / sum(n) OVER ()), 9) AS log_q FROM c")
def log_q(spark, sf):
    q = retrieval.log_q(_log(spark, sf).where(_TRAIN).where(retrieval.positive(_POS)))
    return q.select("video_id", "n", F.round("q", 9).alias("q"), F.round("log_q", 9).alias("log_q"))


@query("""WITH s AS (SELECT a.vec_id AS row_id, CAST(a.vec_id // 16 = b.vec_id // 16 AND a.vec_id = b.vec_id AS INT) AS is_positive, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 0.5 AS z, a.vec_id <> b.vec_id AND a.label = b.label AS hit FROM embeddings a JOIN embeddings b ON a.vec_id // 16 = b.vec_id // 16)
SELECT row_id, round(max(z) + ln(sum(exp(z - m))) - sum(CASE WHEN is_positive = 1 THEN z ELSE 0 END), 6) AS loss FROM (SELECT *, max(z) OVER (PARTITION BY row_id) AS m FROM s WHERE is_positive = 1 OR NOT hit) GROUP BY row_id""")
def full_inbatch_loss(spark, sf):
    """Loss of each row against all rows of its batch of 16; rows that share the label are masked."""
    e = table(spark, sf, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 16))
    a, b = e.select("batch", F.col("vec_id").alias("row_id"), F.col("label").alias("la"), F.col("embedding").alias("q")), e.select("batch", F.col("vec_id").alias("other"), F.col("label").alias("lb"), F.col("embedding").alias("v"))
    s = a.join(b, "batch").select("row_id", (F.col("row_id") == F.col("other")).cast("int").alias("is_positive"), retrieval.dot("q", "v").alias("score"), ((F.col("row_id") != F.col("other")) & (F.col("la") == F.col("lb"))).alias("hit"))
    return retrieval.sampled_softmax(s, "row_id", 0.5).select("row_id", F.round("loss", 6).alias("loss"))
