"""Queries: rolling features, histories, vocabularies, encoders, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedloom.operators import encoding, history, retrieval, windows
from feedloom.plans.common import EV, OR, query
from feedloom.views import LABELS, log_events, log_orders, table, with_split


def _log(spark, sf):
    return with_split(log_events(spark, sf))


def _rolling_sql(keys: str, other: str, prefix: str, labels: tuple, rates: tuple, ws: tuple, need: str = "") -> str:
    """Definition: a target day sees the log rows of the w days before it, by a range join."""
    widest = max(ws)
    ks = keys.split(", ")
    on = " AND ".join(f"l.{k} = t.{k}" for k in ks)
    cols = []
    for w in ws:
        seen = f"l.day >= t.day - INTERVAL {w} DAY"
        cols.append(f"count(*) FILTER ({seen}) AS {prefix}_imp_{w}d")
        cols += [f"CAST(coalesce(sum(l.{c}) FILTER ({seen}), 0) AS BIGINT) AS {prefix}_{c}_{w}d" for c in labels]
        for c in rates:
            num, imp = f"coalesce(sum(l.{c}) FILTER ({seen}), 0)", f"count(*) FILTER ({seen})"
            cols.append(f"round(CASE WHEN {imp} > 0 THEN {num} / {imp} END, 9) AS {prefix}_{c}_rate_{w}d")
            cols.append(f"round(({num} + 20.0 * any_value(g.{c})) / ({imp} + 20.0), 9) AS {prefix}_{c}_smooth_{w}d")
    cols.append(f"count(DISTINCT l.day) AS {prefix}_active_days_{widest}d")
    cols.append(f"count(DISTINCT l.{other}) AS {prefix}_distinct_{widest}d")
    if 1 in ws:
        cols.append(f"round(count(*) FILTER (l.day >= t.day - INTERVAL 1 DAY) / (count(*) / {widest}.0), 9) AS {prefix}_trend")
    return f"""WITH {EV}, g AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in labels)} FROM lg WHERE split = 'warmup'),
t AS (SELECT DISTINCT {', '.join(f'lg.{k}' for k in ks)}, CAST(lg.day + INTERVAL (o) DAY AS DATE) AS day FROM lg, range(1, {widest + 1}) r(o) WHERE CAST(strftime(lg.day + INTERVAL (o) DAY, '%Y%m%d') AS INT) <= 20240130){need}
SELECT {', '.join(f't.{k}' for k in ks)}, CAST(strftime(t.day, '%Y%m%d') AS INT) AS date, {', '.join(cols)}, 1 AS {prefix}_has_history
FROM {'tn' if need else 't'} t JOIN lg l ON {on} AND l.day >= t.day - INTERVAL {widest} DAY AND l.day < t.day CROSS JOIN g GROUP BY ALL"""


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_rolling_sql("user_id", "video_id", "u", LABELS, LABELS, (1, 3, 7)))
def t1_user_rolling(spark, sf):
    log = _log(spark, sf)
    return _rounded(windows.rolling(log, ["user_id"], "video_id", list(LABELS), list(LABELS), [1, 3, 7], windows.priors(log, list(LABELS)), "u", last=20240130))


@query(_rolling_sql("video_id", "user_id", "i", LABELS, LABELS, (1, 3, 7)))
def t1_item_rolling(spark, sf):
    log = _log(spark, sf)
    return _rounded(windows.rolling(log, ["video_id"], "user_id", list(LABELS), list(LABELS), [1, 3, 7], windows.priors(log, list(LABELS)), "i", last=20240130))


_PAIR = ("is_click", "long_view", "is_like")


@query(_rolling_sql("user_id, author_id", "video_id", "p", _PAIR, _PAIR[:2], (3, 7), need=", tn AS (SELECT DISTINCT t.* FROM t SEMI JOIN (SELECT user_id, author_id, day FROM lg WHERE split = 'train') n USING (user_id, author_id, day))"))
def t1_pair_rolling(spark, sf):
    log = _log(spark, sf)
    need = log.where("split = 'train'").select("user_id", "author_id", "date")
    return _rounded(windows.rolling(log, ["user_id", "author_id"], "video_id", list(_PAIR), list(_PAIR[:2]), [3, 7], windows.priors(log, list(_PAIR)), "p", need=need, last=20240130))


@query(f"WITH {EV} SELECT {', '.join(f'round(avg({c}), 9) AS g_{c}' for c in LABELS)} FROM lg WHERE split = 'warmup'")
def warmup_priors(spark, sf):
    return _rounded(windows.priors(_log(spark, sf), list(LABELS)))


# ---- histories

_POS = "p AS (SELECT DISTINCT user_id, ts, video_id FROM lo WHERE positive = 1)"


@query(f"""WITH {OR}, {_POS}, m AS (SELECT DISTINCT user_id, ts FROM lo)
SELECT m.user_id, m.ts, coalesce(array_to_string(list(p.video_id ORDER BY p.ts DESC, p.video_id DESC)[1:20], ','), '') AS hist, CAST(least(count(p.video_id), 20) AS INT) AS hist_len
FROM m LEFT JOIN p ON p.user_id = m.user_id AND p.ts < m.ts GROUP BY m.user_id, m.ts""")
def history_strict_asof(spark, sf):
    log = log_orders(spark, sf)
    positives = log.where("positive = 1").select("user_id", "ts", "video_id").distinct()
    h = history.strict_history(log, positives, "user_id", "ts", "video_id", 20)
    return h.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist"), "hist_len")


@query(f"""WITH {OR}, {_POS}, m AS (SELECT DISTINCT user_id, ts FROM lo)
SELECT m.user_id, m.ts, count(DISTINCT p.video_id) AS n FROM m JOIN p ON p.user_id = m.user_id AND p.ts < m.ts GROUP BY m.user_id, m.ts""")
def history_all_before(spark, sf):
    log = log_orders(spark, sf)
    seen = history.all_before(log, log.where("positive = 1"), "user_id", "ts", "video_id")
    return seen.groupBy("user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))


@query(f"""WITH {OR}, {_POS}, m AS (SELECT DISTINCT user_id, ts FROM lo), v AS (SELECT video_id, row_number() OVER (ORDER BY n DESC, video_id) + 1 AS idx FROM (SELECT video_id, count(*) AS n FROM lo WHERE year <= 1998 GROUP BY video_id HAVING count(*) >= 20)),
h AS (SELECT m.user_id, m.ts, list(coalesce(v.idx, 1) ORDER BY p.ts DESC, p.video_id DESC)[1:10] AS idx FROM m JOIN p ON p.user_id = m.user_id AND p.ts < m.ts LEFT JOIN v ON v.video_id = p.video_id GROUP BY ALL)
SELECT m.user_id, m.ts, array_to_string(list_resize(coalesce(h.idx, []), 10, 0), ',') AS hist_idx FROM m LEFT JOIN h USING (user_id, ts)""")
def history_index_mapping(spark, sf):
    log = log_orders(spark, sf)
    counts = log.where("year <= 1998").groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 20")
    positives = log.where("positive = 1").select("user_id", "ts", "video_id").distinct()
    h = history.strict_history(log, positives, "user_id", "ts", "video_id", 10)
    mapped = history.map_history(h, encoding.vocabulary(counts), ["user_id", "ts"])
    return mapped.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.array_join(history.pad("hist_idx", 10).cast("array<string>"), ",").alias("hist_idx"))


# ---- vocabularies and static tables

_TRAIN = "split IN ('warmup', 'train')"


def _train(spark, sf):
    return _log(spark, sf).where(_TRAIN)


@query(f"""WITH {OR}, c AS (SELECT video_id AS id, count(*) AS n FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 18),
x AS (SELECT id, n, 0 AS g FROM c UNION ALL SELECT DISTINCT video_id, 0, 1 FROM lo WHERE year <= 1998 AND positive = 1 AND video_id NOT IN (SELECT id FROM c))
SELECT id, n, CAST(row_number() OVER (ORDER BY g, n DESC, id) + 1 AS INT) AS "index" FROM x""")
def vocab_video(spark, sf):
    train = log_orders(spark, sf).where("year <= 1998")
    first = train.groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 18")
    return encoding.ordered_union(first, train.where("positive = 1").select(F.col("video_id").alias("id")))


@query(f"""WITH {OR}, c AS (SELECT DISTINCT video_id FROM lo WHERE year <= 1998), x AS (SELECT author_id AS id, count(DISTINCT video_id) AS n FROM lo SEMI JOIN c USING (video_id) GROUP BY 1 HAVING count(DISTINCT video_id) >= 2)
SELECT id, n, CAST(row_number() OVER (ORDER BY n DESC, id) + 1 AS INT) AS "index" FROM x""")
def vocab_author(spark, sf):
    shown = log_orders(spark, sf).where("video_id IS NOT NULL").repartition("video_id").groupBy("author_id", "video_id").agg(F.min("year").alias("year"))
    early = shown.withColumn("year", F.min("year").over(Window.partitionBy("video_id"))).where("year <= 1998")  # a row for each author and video
    n = early.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 2")
    return encoding.vocabulary(n)


_TAGS = "SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS tag FROM part"


@query(f"""WITH t AS ({_TAGS}), x AS (SELECT tag AS id, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1) SELECT id, n, CAST(row_number() OVER (ORDER BY n DESC, id) + 1 AS INT) AS "index" FROM x""")
def vocab_tag(spark, sf):
    t = table(spark, sf, "part").select(F.explode(encoding.tags("p_name", True, " ")).alias("id"))
    return encoding.vocabulary(t.groupBy("id").agg(F.count("*").alias("n")))


@query(f"""WITH t AS ({_TAGS}), v AS (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) + 1 AS idx FROM (SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1)),
b AS (SELECT p_brand, row_number() OVER (ORDER BY n DESC, p_brand) + 1 AS idx FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2)),
g AS (SELECT p_partkey, list_sort(list(DISTINCT idx)) AS tags FROM t JOIN v USING (tag) GROUP BY 1)
SELECT p.p_partkey AS video_id, CAST(coalesce(b.idx, 1) AS INT) AS author_index, array_to_string(coalesce(g.tags, [1]), ',') AS tag_indices, CAST(coalesce(len(g.tags), 0) AS INT) AS n_tags, p_size AS duration_ms, CAST(p_size IS NOT NULL AS INT) AS has_duration
FROM part p LEFT JOIN b USING (p_brand) LEFT JOIN g USING (p_partkey)""")
def item_static(spark, sf):
    """Tags are trimmed, distinct and ascending; an item without tags has the unknown tag."""
    part = table(spark, sf, "part")
    tags = part.select("p_partkey", F.explode(encoding.tags("p_name", True, " ")).alias("id"))
    v = encoding.vocabulary(tags.groupBy("id").agg(F.count("*").alias("n")))
    b = encoding.vocabulary(part.groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("n")).where("n >= 2")).select(F.col("id").alias("p_brand"), F.col("index").alias("author_index"))
    g = tags.join(F.broadcast(v), "id").groupBy("p_partkey").agg(F.sort_array(F.collect_set("index")).alias("tags"))
    j = part.join(b, "p_brand", "left").join(g, "p_partkey", "left")
    return j.select(F.col("p_partkey").alias("video_id"), F.coalesce("author_index", F.lit(1)).alias("author_index"), F.array_join(F.coalesce("tags", F.array(F.lit(1))).cast("array<string>"), ",").alias("tag_indices"), F.when(F.col("tags").isNull(), 0).otherwise(F.size("tags")).alias("n_tags"), F.col("p_size").alias("duration_ms"), F.col("p_size").isNotNull().cast("int").alias("has_duration"))


@query(f"""WITH {EV}, x AS (SELECT author_id AS id, count(*) AS n FROM lg WHERE {_TRAIN} GROUP BY 1 HAVING count(*) >= 5) SELECT id, n, CAST(row_number() OVER (ORDER BY n DESC, id) + 1 AS INT) AS "index" FROM x""")
def rank_vocab_author(spark, sf):
    """By training exposures, without labels."""
    n = _train(spark, sf).groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 5")
    return encoding.vocabulary(n)


# ---- encoders and samples

@query("""WITH x AS (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_mktsegment) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
s AS (SELECT avg(coalesce(c_acctbal, 0)) AS m, stddev_samp(coalesce(c_acctbal, 0)) AS d FROM customer)
SELECT c_custkey AS user_id, round((coalesce(c_acctbal, 0) - m) / d, 6) AS acctbal, CAST(coalesce(code, 0) AS INT) AS segment FROM customer LEFT JOIN x ON x.value = c_mktsegment CROSS JOIN s""")
def user_static_encoded(spark, sf):
    c = table(spark, sf, "customer")
    codes = encoding.category_map(c, "c_mktsegment")
    z = encoding.apply_standard(c.select("c_custkey", "c_mktsegment", "c_acctbal"), encoding.fit_standard(c, ["c_acctbal"], log=False), ["c_acctbal"], log=False)
    j = z.join(F.broadcast(codes), F.col("c_mktsegment") == F.col("value"), "left")
    return j.select(F.col("c_custkey").alias("user_id"), F.round("c_acctbal", 6).alias("acctbal"), F.coalesce("code", F.lit(0)).alias("segment"))


@query(f"""WITH {EV}, d AS (SELECT user_id, date, count(*) AS imp, sum(is_click) AS clicks FROM lg GROUP BY 1, 2), j AS (SELECT coalesce(d.imp, 0) AS imp, coalesce(d.clicks, 0) AS clicks FROM lg LEFT JOIN d ON d.user_id = lg.user_id AND d.date = CAST(strftime(lg.day - INTERVAL 1 DAY, '%Y%m%d') AS INT) WHERE split = 'train')
SELECT round(avg(ln(1 + imp)), 9) AS imp_mean, round(avg(ln(1 + clicks)), 9) AS clicks_mean, round(stddev_samp(ln(1 + imp)), 9) AS imp_std, round(stddev_samp(ln(1 + clicks)), 9) AS clicks_std FROM j""")
def encoder_stats(spark, sf):
    """Statistics weighted by training samples: cold samples count with the fill value."""
    log = _log(spark, sf)
    d = windows.daily(log, ["user_id"], ["is_click"]).select("user_id", windows.as_int(F.date_add(windows.as_date("date"), 1)).alias("date"), "imp", F.col("is_click").alias("clicks"))
    return _rounded(encoding.fit_standard(log.where("split = 'train'").join(d, ["user_id", "date"], "left"), ["imp", "clicks"]))


@query(f"""WITH {EV}, d AS (SELECT user_id, date, count(*) AS imp, sum(is_click) AS clicks FROM lg GROUP BY 1, 2), s AS (SELECT avg(ln(1 + imp)) AS m, stddev_samp(ln(1 + imp)) AS v FROM d)
SELECT d.user_id, d.date, round((ln(1 + imp) - m) / v, 6) AS imp FROM d CROSS JOIN s""")
def encoder_transform(spark, sf):
    d = windows.daily(_log(spark, sf), ["user_id"], ["is_click"]).select("user_id", "date", "imp")
    out = encoding.apply_standard(d, encoding.fit_standard(d, ["imp"]), ["imp"])
    return out.select("user_id", "date", F.round("imp", 6).alias("imp"))


@query(f"WITH {EV} SELECT round(avg(is_click), 9) AS prior FROM lg WHERE split = 'warmup'")
def prior_backsolve(spark, sf):
    log = _log(spark, sf)
    r = windows.rolling(log, ["user_id"], "video_id", ["is_click"], ["is_click"], [7], windows.priors(log, ["is_click"]), "u")
    g = encoding.prior_of(F.col("u_is_click_smooth_7d"), F.col("u_is_click_7d"), F.col("u_imp_7d"), windows.ALPHA)
    return r.agg(F.round(F.percentile(g, F.lit(0.5)), 9).alias("prior"))


@query(f"""WITH {EV}, g AS (SELECT avg(is_click) AS g FROM lg WHERE split = 'warmup')
SELECT s.event_id, s.split, count(l.event_id) AS u_imp_7d, round((coalesce(sum(l.is_click), 0) + 20.0 * any_value(g)) / (count(l.event_id) + 20.0), 9) AS u_is_click_smooth_7d, CAST(count(l.event_id) > 0 AS INT) AS u_has_history
FROM lg s LEFT JOIN lg l ON l.user_id = s.user_id AND l.day < s.day AND l.day >= s.day - INTERVAL 7 DAY CROSS JOIN g WHERE s.split IN ('train', 'valid', 'test') GROUP BY s.event_id, s.split""")
def sample_assembly(spark, sf):
    """Samples with their T-1 features; cold samples get counts 0, the prior and no history."""
    log = _log(spark, sf)
    samples = log.where("split IN ('train', 'valid', 'test')")
    prior = windows.priors(log, ["is_click"])
    r = windows.rolling(log, ["user_id"], "video_id", ["is_click"], ["is_click"], [7], prior, "u", need=samples).select("user_id", "date", "u_imp_7d", "u_is_click_smooth_7d", "u_has_history")
    j = samples.join(r, ["user_id", "date"], "left").crossJoin(F.broadcast(prior))
    return j.select("event_id", "split", F.coalesce("u_imp_7d", F.lit(0)).alias("u_imp_7d"), F.round(F.coalesce("u_is_click_smooth_7d", "g_is_click"), 9).alias("u_is_click_smooth_7d"), F.coalesce("u_has_history", F.lit(0)).alias("u_has_history"))


@query(f"""WITH {OR}, f AS (SELECT video_id, min(ts) AS up FROM lo GROUP BY 1) SELECT year, round(avg(ln(1 + greatest(date_diff('day', CAST(f.up AS DATE), CAST(lo.ts AS DATE)), 0))), 6) AS mean_log_age FROM lo JOIN f USING (video_id) GROUP BY year""")
def item_age(spark, sf):
    log = log_orders(spark, sf)
    up = log.groupBy("video_id").agg(F.min("ts").alias("up"))
    age = F.log1p(F.greatest(F.datediff("ts", "up"), F.lit(0)))
    return log.join(up, "video_id").groupBy("year").agg(F.round(F.avg(age), 6).alias("mean_log_age"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY label, i""")
def mean_pooling(spark, sf):
    """Mean vector of each group, dimension by dimension."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query(f"""WITH {EV}, k AS (SELECT event_id FROM lg WHERE is_click = 1 OR long_view = 1) SELECT count(*) AS n, CAST(sum(('0x' || substr(md5('42|' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 1000 < 100) AS BIGINT) AS kept_10, CAST(sum(('0x' || substr(md5('42|' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 1000 < 10) AS BIGINT) AS kept_1 FROM k""")
def controlled_sparsity(spark, sf):
    """Extension: keep a share of positive rows by hash; smaller shares are nested in larger ones."""
    pos = _log(spark, sf).where(retrieval.positive(["is_click", "long_view"]))
    d = retrieval.draw(42, "event_id") % 1000
    return pos.agg(F.count("*").alias("n"), F.sum((d < 100).cast("long")).alias("kept_10"), F.sum((d < 10).cast("long")).alias("kept_1"))
