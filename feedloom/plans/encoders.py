"""Queries: the encoder over all classes of columns, pooling of tags, loss with popularity correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import encoding, retrieval, spec, windows
from feedloom.plans.common import EV, query
from feedloom.views import log_events, table, with_split

_PARTS = """p AS (SELECT p_partkey AS id, p_retailprice AS price, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END AS size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS brand,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 5) / 5.0 END AS rate, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS flag FROM part)"""


@query(f"""WITH {_PARTS}, s AS (SELECT avg(ln(1 + coalesce(price, 0))) AS pm, stddev_samp(ln(1 + coalesce(price, 0))) AS ps, median(size) AS med, avg(ln(1 + size)) AS zm, stddev_samp(ln(1 + size)) AS zs FROM p),
b AS (SELECT brand, row_number() OVER (ORDER BY brand) AS code FROM (SELECT DISTINCT brand FROM p WHERE brand IS NOT NULL)), r AS (SELECT * FROM p UNION ALL SELECT 0, NULL, NULL, NULL, NULL, NULL)
SELECT r.id, round((ln(1 + coalesce(price, 0)) - pm) / ps, 6) AS price, round((ln(1 + coalesce(size, med)) - zm) / zs, 6) AS size, CAST(coalesce(code, 0) AS INT) AS brand, CAST(coalesce(rate, 0.25) AS DOUBLE) AS rate, CAST(coalesce(flag, 0) AS DOUBLE) AS flag FROM r CROSS JOIN s LEFT JOIN b ON b.brand = r.brand""")
def encoded_matrix(spark, sf):
    """Items encoded by a spec of all classes, with the cold row 0 through the same expressions; a constant is dropped."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        k.cast("long").alias("id"), F.col("p_retailprice").alias("price"), F.when(k % 10 != 0, F.col("p_size")).alias("size"), F.when(k % 7 != 0, F.col("p_brand")).alias("brand"),
        F.when(k % 3 != 0, (k % 5) / 5.0).alias("rate"), F.when(k % 2 == 0, 1).alias("flag"), F.lit("same").alias("constant"),
    )
    kinds = {"price": "count", "size": "numeric", "brand": "category", "rate": "smooth", "flag": "zero", "constant": "category"}
    made = spec.fit(p, kinds, {"rate": 0.25})
    out = spec.apply(spec.with_cold_row(p, "id"), made, "id")
    return out.select("id", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"), "brand", "rate", "flag")


@query(f"""WITH {EV}, f AS (SELECT DISTINCT lg.video_id, CAST(lg.day + CAST(o AS INT) AS DATE) AS day FROM lg, range(1, 8) r(o)),
t AS (SELECT f.video_id, f.day, count(*) AS imp, sum(is_click) AS clicks FROM f JOIN lg ON lg.video_id = f.video_id AND lg.day < f.day AND lg.day >= f.day - 7 GROUP BY 1, 2), g AS (SELECT avg(is_click) AS g FROM lg WHERE split = 'warmup'),
s AS (SELECT avg(ln(1 + coalesce(imp, 0))) AS im, stddev_samp(ln(1 + coalesce(imp, 0))) AS isd, avg(ln(1 + coalesce(clicks, 0))) AS cm, stddev_samp(ln(1 + coalesce(clicks, 0))) AS csd FROM lg LEFT JOIN t ON t.video_id = lg.video_id AND t.day = lg.day WHERE split = 'train'),
r AS (SELECT video_id, day, CAST(strftime(day, '%Y%m%d') AS INT) AS date, imp, clicks, (clicks + 20.0 * g) / (imp + 20.0) AS sm FROM t, g UNION ALL SELECT 0, NULL, 0, NULL, NULL, NULL)
SELECT CAST(video_id AS INT) AS video_id, date, round((ln(1 + coalesce(imp, 0)) - im) / isd, 6) AS i_imp_7d, round((ln(1 + coalesce(clicks, 0)) - cm) / csd, 6) AS i_is_click_7d, round(coalesce(sm, g), 9) AS i_is_click_smooth_7d FROM r, s, g WHERE date <= 20240130""")
def encoder_train_weighted(spark, sf):
    """Item features of the days before, standardised by what the training rows see: cold rows count as 0, busy items often."""
    log = with_split(log_events(spark, sf))
    prior = windows.priors(log, ["is_click"])
    rolled = windows.rolling(log, ["video_id"], "user_id", ["is_click"], ["is_click"], [7], prior, "i", last=20240130)
    counts = ["i_imp_7d", "i_is_click_7d"]
    seen = log.where("split = 'train'").select("video_id", "date").join(rolled.select("video_id", "date", *counts), ["video_id", "date"], "left")
    kinds = dict.fromkeys(counts, "count") | {"i_is_click_smooth_7d": "smooth"}
    made = spec.fit(rolled, kinds, {"i_is_click_smooth_7d": prior.first()[0]}, samples=seen)
    cold = rolled.sparkSession.range(1).select(F.lit(0).cast("int").alias("video_id"), F.lit(0).alias("date"), *[F.lit(None).cast("double").alias(c) for c in kinds])
    out = spec.apply(rolled.select("video_id", "date", *kinds).unionByName(cold), made, "video_id", "date")
    return out.select("video_id", "date", *[F.round(c, 6).alias(c) for c in counts], F.round("i_is_click_smooth_7d", 9).alias("i_is_click_smooth_7d"))


@query("""WITH t AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS tags FROM part), x AS (SELECT id, unnest(tags) AS tag FROM t), v AS (SELECT tag, row_number() OVER (ORDER BY count(*) DESC, tag) + 1 AS ix FROM x WHERE tag <> '' GROUP BY tag),
s AS (SELECT x.id, v.ix FROM x JOIN v USING (tag) WHERE v.ix % 5 <> 0), d AS (SELECT id, count(*) AS n, round(avg(ln(1 + ix)), 9) AS x FROM s GROUP BY id) SELECT t.id, coalesce(n, 0) AS n, coalesce(x, 0.0) AS x FROM t LEFT JOIN d USING (id)""")
def tag_pooling(spark, sf):
    """Mean of the vectors of an item's tags, here of one number; padded places don't count, an item without tags gets 0."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tags"))
    tags = rows.select("id", F.explode("tags").alias("tag"))
    vocab = encoding.vocabulary(tags.where("tag <> ''").groupBy(F.col("tag").alias("id")).agg(F.count("*").alias("n")))
    placed = tags.join(vocab.select(F.col("id").alias("tag"), "index"), "tag").withColumn("index", F.when(F.col("index") % 5 == 0, encoding.PAD).otherwise(F.col("index")))
    real = F.col("index") != encoding.PAD
    pooled = placed.groupBy("id").agg(F.count_if(real).alias("n"), F.round(F.avg(F.when(real, F.log1p("index"))), 9).alias("x"))
    return rows.select("id").join(pooled, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0.0)).alias("x"))


@query("""WITH q AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS log_q FROM embeddings GROUP BY label), e AS (SELECT vec_id, vec_id // 16 AS batch, label, CAST(embedding AS DOUBLE[]) AS v, log_q FROM embeddings JOIN q USING (label)),
s AS (SELECT a.vec_id AS row_id, a.vec_id = b.vec_id AS own, list_dot_product(a.v, b.v) / 0.5 - b.log_q AS z FROM e a JOIN e b ON a.batch = b.batch WHERE a.vec_id = b.vec_id OR a.label <> b.label), m AS (SELECT *, max(z) OVER (PARTITION BY row_id) AS top FROM s)
SELECT row_id, round(any_value(top) + ln(sum(exp(z - top))) - sum(CASE WHEN own THEN z ELSE 0 END), 6) AS loss FROM m GROUP BY row_id""")
def corrected_inbatch_loss(spark, sf):
    """Loss against the batch with every column's log q taken off its score; rows of the same label are masked."""
    e = table(spark, sf, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 16))
    n = e.groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    e = e.join(n.crossJoin(total).select("label", F.log(F.col("n") / F.col("total")).alias("log_q")), "label")
    a = e.select("batch", F.col("vec_id").alias("row_id"), F.col("label").alias("la"), F.col("embedding").alias("q"))
    b = e.select("batch", F.col("vec_id").alias("other"), F.col("label").alias("lb"), F.col("embedding").alias("v"), "log_q")
    own = F.col("row_id") == F.col("other")
    s = a.join(b, "batch").select("row_id", own.cast("int").alias("is_positive"), (retrieval.dot("q", "v") - 0.5 * F.col("log_q")).alias("score"), (~own & (F.col("la") == F.col("lb"))).alias("hit"))
    return retrieval.sampled_softmax(s, "row_id", 0.5).select("row_id", F.round("loss", 6).alias("loss"))
