"""Queries: whole training samples, pair features, scores from recent histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import encoding, history, retrieval, samples, windows
from feedloom.plans.common import EV, OR, once, query
from feedloom.plans.retrieval import _IN_CATALOG, _cosine_sql, _moments, _pairs, order_log
from feedloom.views import log_events, with_split

_KEPT = "split IN ('train', 'valid', 'test')"
_PRIOR = "g AS (SELECT avg(is_click) AS g FROM lg WHERE split = 'warmup')"


def _log(spark, sf):
    return with_split(log_events(spark, sf))


def _recent(log, kept, keys, prior, prefix):
    return windows.rolling(log, keys, "tab", ["is_click"], ["is_click"], [7], prior, prefix, need=kept.select(*keys, "date"))


def _window_sql(name: str, keys: list[str]) -> str:
    same = " AND ".join(f"l.{k} = s.{k}" for k in keys)
    return f"{name} AS (SELECT s.event_id, count(l.event_id) AS imp, coalesce(sum(l.is_click), 0) AS clicks FROM lg s LEFT JOIN lg l ON {same} AND l.day < s.day AND l.day >= s.day - INTERVAL 7 DAY WHERE s.{_KEPT} GROUP BY 1)"


@query(f"""WITH {EV}, {_PRIOR}, {_window_sql('f', ['user_id', 'author_id'])}, x AS (SELECT event_id, split, ln(1 + imp) AS a, ln(1 + clicks) AS b, (clicks + 20.0 * g) / (imp + 20.0) AS c FROM f JOIN lg USING (event_id) CROSS JOIN g),
st AS (SELECT avg(a) AS am, stddev_pop(a) AS ad, avg(b) AS bm, stddev_pop(b) AS bd, avg(c) AS cm, stddev_pop(c) AS cd FROM x WHERE split = 'train')
SELECT event_id, split, CASE WHEN ad > 1e-12 THEN round((a - am) / ad, 6) ELSE 0.0 END AS p_imp_7d, CASE WHEN bd > 1e-12 THEN round((b - bm) / bd, 6) ELSE 0.0 END AS p_is_click_7d, CASE WHEN cd > 1e-12 THEN round((c - cm) / cd, 6) ELSE 0.0 END AS p_is_click_smooth_7d FROM x CROSS JOIN st""")
def pair_features(spark, sf):
    """User and author features of every sample, damped and scaled by the training split; cold pairs get 0 and the prior."""
    log = _log(spark, sf)
    kept, prior = log.where(_KEPT), windows.priors(log, ["is_click"])
    part = _recent(log, kept, ["user_id", "author_id"], prior, "p")
    cold = {"p_imp_7d": F.lit(0), "p_is_click_7d": F.lit(0), "p_is_click_smooth_7d": F.col("g_is_click")}
    full = samples.assemble(kept.crossJoin(F.broadcast(prior)), [(part, ["user_id", "author_id", "date"], cold)])
    scaled = {"p_imp_7d": F.log1p("p_imp_7d"), "p_is_click_7d": F.log1p("p_is_click_7d"), "p_is_click_smooth_7d": F.col("p_is_click_smooth_7d")}
    return samples.standardised(full, F.col("split") == "train", scaled, 6).select("event_id", "split", *scaled)


@query(f"""WITH {EV}, {_PRIOR}, {_window_sql('u', ['user_id'])}, {_window_sql('i', ['video_id'])}, {_window_sql('p', ['user_id', 'author_id'])},
v AS (SELECT video_id, row_number() OVER (ORDER BY n DESC, video_id) + 1 AS ix FROM (SELECT video_id, count(*) AS n FROM lg WHERE split IN ('warmup', 'train') AND video_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)),
pos AS (SELECT DISTINCT user_id, time_ms, video_id FROM lg WHERE (is_click = 1 OR long_view = 1) AND video_id IS NOT NULL),
h AS (SELECT s.event_id, list(coalesce(v.ix, 1) ORDER BY pos.time_ms DESC, pos.video_id DESC)[1:10] AS hist FROM lg s JOIN pos ON pos.user_id = s.user_id AND pos.time_ms < s.time_ms LEFT JOIN v ON v.video_id = pos.video_id WHERE s.{_KEPT} GROUP BY 1)
SELECT s.event_id, s.split, CAST(coalesce(v.ix, 1) AS INT) AS target_idx, coalesce(array_to_string(h.hist, ','), '') AS hist_idx, CAST(coalesce(len(h.hist), 0) AS INT) AS hist_len, u.imp AS u_imp_7d, i.imp AS i_imp_7d, p.imp AS p_imp_7d,
round((u.clicks + 20.0 * g) / (u.imp + 20.0), 9) AS u_is_click_smooth_7d, round((i.clicks + 20.0 * g) / (i.imp + 20.0), 9) AS i_is_click_smooth_7d, round((p.clicks + 20.0 * g) / (p.imp + 20.0), 9) AS p_is_click_smooth_7d
FROM lg s CROSS JOIN g JOIN u USING (event_id) JOIN i USING (event_id) JOIN p USING (event_id) LEFT JOIN v ON v.video_id = s.video_id LEFT JOIN h ON h.event_id = s.event_id WHERE s.{_KEPT}""")
def sample_full(spark, sf):
    """Samples with history and target as indices and with user, item and pair features of the days before."""
    log = _log(spark, sf)
    kept, prior = log.where(_KEPT), windows.priors(log, ["is_click"])
    counts = log.where("split IN ('warmup', 'train') AND video_id IS NOT NULL").groupBy(F.col("video_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 5")
    vocab = encoding.vocabulary(counts).select("id", "index")
    positives = log.where(retrieval.positive(["is_click", "long_view"]) & F.col("video_id").isNotNull()).select("user_id", "time_ms", "video_id").distinct()
    hist = history.map_history(history.strict_history(kept, positives, n=10), vocab, ["user_id", "time_ms"])
    parts = [(hist, ["user_id", "time_ms"], {"hist_idx": F.array().cast("array<int>")}), (vocab.select(F.col("id").alias("video_id"), F.col("index").alias("target_idx")), ["video_id"], {"target_idx": F.lit(encoding.OOV)})]
    for prefix, keys in (("u", ["user_id"]), ("i", ["video_id"]), ("p", ["user_id", "author_id"])):
        cold = {f"{prefix}_imp_7d": F.lit(0), f"{prefix}_is_click_smooth_7d": F.col("g_is_click")}
        parts.append((_recent(log, kept, keys, prior, prefix), [*keys, "date"], cold))
    full = samples.assemble(kept.crossJoin(F.broadcast(prior)), parts)
    listed = F.array_join(F.col("hist_idx").cast("array<string>"), ",").alias("hist_idx")
    counted = [f"{p}_imp_7d" for p in "uip"]
    return full.select("event_id", "split", "target_idx", listed, F.size("hist_idx").alias("hist_len"), *counted, *[F.round(f"{p}_is_click_smooth_7d", 9).alias(f"{p}_is_click_smooth_7d") for p in "uip"])


_RECENT = """m AS (SELECT DISTINCT user_id, ts FROM lo WHERE year = 2001 AND positive = 1), d AS (SELECT DISTINCT user_id, ts, video_id FROM lo WHERE positive = 1),
r AS (SELECT m.user_id, m.ts, list(d.video_id ORDER BY d.ts DESC, d.video_id DESC)[1:20] AS hist FROM m JOIN d ON d.user_id = m.user_id AND d.ts < m.ts GROUP BY ALL), h AS (SELECT DISTINCT user_id, ts, unnest(hist) AS i FROM r)"""


def _recent_items(log):
    moments, positives = _moments(log), log.where("positive = 1").select("user_id", "ts", "video_id").distinct()
    recent = history.strict_history(moments, positives, "user_id", "ts", "video_id", 20)
    return moments, recent.select("user_id", "ts", F.explode("hist").alias("video_id")).distinct()


@query(_cosine_sql(False, 100, _IN_CATALOG) + f""", {_RECENT}, sc AS (SELECT h.user_id, h.ts, t.j, round_even(sum(t.sim), 6) AS score FROM h JOIN t ON t.i = h.i AND t.rank <= 100 GROUP BY ALL), c AS (SELECT video_id FROM lo WHERE year <= 1998 GROUP BY 1 HAVING count(*) >= 20),
f AS (SELECT m.user_id, m.ts, c.video_id, coalesce(sc.score, 0.0) AS score, CASE WHEN sc.score > 0 THEN 0 ELSE 1 END AS padded FROM m CROSS JOIN c LEFT JOIN sc ON sc.user_id = m.user_id AND sc.ts = m.ts AND sc.j = c.video_id),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY padded, score DESC, CASE WHEN padded = 1 THEN -video_id ELSE video_id END) AS rank FROM f)
SELECT user_id, ts, video_id, score, padded, CAST(rank AS INT) AS rank, CAST(sum(padded) OVER (PARTITION BY user_id, ts) AS INT) AS n_padded FROM z WHERE rank <= 10""")
def itemcf_recent_topk(spark, sf):
    """Top-k by similarity to the 20 latest items before the moment; pads descend by item, and their number is told."""
    log = order_log(spark, sf)
    cat = once(retrieval.catalog(log.where("year <= 1998"), 20))
    sims = retrieval.item_cosine(_pairs(log), 100, places=6, candidates=cat)
    moments, recent = _recent_items(log)
    top = retrieval.padded_top_k(retrieval.cosine_scores(recent, sims, ["user_id", "ts"], places=6), moments, cat, ["user_id", "ts"], 10, descending=True, within=True)
    return top.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "video_id", "score", "padded", "rank", "n_padded")


@query(f"""WITH {OR}, p AS (SELECT DISTINCT user_id AS u, video_id AS i FROM lo WHERE positive = 1 AND year <= 1998), {_RECENT} SELECT i AS video_id, count(*) AS moments FROM h WHERE i IN (SELECT i FROM p) GROUP BY 1""")
def itemcf_row_universe(spark, sf):
    """Items of the asked histories that the similarity table has rows for, and how many moments ask for each."""
    log = order_log(spark, sf)
    known = _pairs(log).select("video_id").distinct()
    return _recent_items(log)[1].join(known, "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("moments"))
