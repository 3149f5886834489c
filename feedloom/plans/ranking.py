"""Queries: batches of an epoch, the ranking models' thirteen channels, training over embedded channels, equality of runs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import encoding, epochs, guards, history, metrics, multitask, order, ranking, retrieval, spec, windows
from feedloom.operators.stage import Stage
from feedloom.plans.common import EV, query
from feedloom.sources import weights
from feedloom.views import LABELS, log_events, table, with_split

_KEPT = "split IN ('train', 'valid', 'test')"
SEED = 42
#: Rows of a batch, as the reference's ranking models have (configs/*.yaml), whatever the length of the log.
BATCH = 2048


def _log(spark, sf):
    return with_split(log_events(spark, sf))


@query(f"""WITH RECURSIVE {EV}, tr AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS number FROM lg WHERE split = 'train'),
{epochs.order_sql("tr", "(SELECT count(*) FROM tr)", SEED, [1, 2])}
SELECT tr.event_id, CAST(epoch AS INT) AS epoch, place, CAST(place // 512 AS INT) AS batch FROM ord JOIN tr USING (number)""")
def epoch_batches(spark, sf):
    """Place and batch of every training row in two epochs, computed from its number alone."""
    rows = order.numbered(_log(spark, sf).where("split = 'train'").select("event_id"), [F.col("event_id")], "number", 0).withColumn("number", F.col("number").cast("long"))
    n = rows.count()
    out = None
    for e in (1, 2):
        one = epochs.batched(rows, "number", n, 512, SEED, e).select("event_id", F.lit(e).alias("epoch"), "place", "batch")
        out = one if out is None else out.unionByName(one)
    return out


# ---- channels

def _known(c: str) -> str:
    return f"CAST({c} IS NOT NULL AS INT)"


_ITEMS = """it AS (SELECT p_partkey AS video_id, CASE WHEN p_partkey % 10 <> 0 THEN p_size * 1000 END AS duration_ms, CASE WHEN p_partkey % 7 <> 0 THEN DATE '2023-12-01' + CAST(2 * (p_size % 30) AS INT) END AS upload, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS tag FROM part)"""
_VOCABS = """ex AS (SELECT video_id, author_id FROM lg WHERE split = 'train' AND video_id IS NOT NULL),
vv AS (SELECT video_id, row_number() OVER (ORDER BY count(*) DESC, video_id) + 1 AS ix FROM ex GROUP BY 1 HAVING count(*) >= 35),
va AS (SELECT author_id, row_number() OVER (ORDER BY count(*) DESC, author_id) + 1 AS ix FROM ex GROUP BY 1 HAVING count(*) >= 220),
tt AS (SELECT video_id, pos, t FROM (SELECT video_id, unnest(string_split(tag, ' ')) AS t, generate_subscripts(string_split(tag, ' '), 1) AS pos FROM it) WHERE t <> ''),
vt AS (SELECT t, row_number() OVER (ORDER BY count(*) DESC, t) + 1 AS ix FROM ex JOIN tt USING (video_id) GROUP BY 1),
vh AS (SELECT video_id, row_number() OVER (ORDER BY count(*) DESC, video_id) + 1 AS ix FROM lg WHERE split IN ('warmup', 'train') AND video_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)"""


def _items(spark, sf) -> DataFrame:
    """Side table of the videos: duration, upload date and tags, each missing for some."""
    k = F.col("p_partkey")
    upload = F.date_add(F.lit("2023-12-01").cast("date"), (2 * (F.col("p_size") % 30)).cast("int"))
    return table(spark, sf, "part").select(k.alias("video_id"), F.when(k % 10 != 0, F.col("p_size") * 1000).alias("duration_ms"), F.when(k % 7 != 0, upload).alias("upload"), F.when(k % 11 != 0, F.col("p_name")).alias("tag"))


@dataclass
class Vocabs:
    video: DataFrame
    author: DataFrame
    tag: DataFrame
    history: DataFrame

    def all(self) -> list[DataFrame]:
        return [self.video, self.author, self.tag, self.history]


def _count(rows: DataFrame, col: str, least: int) -> DataFrame:
    return rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _vocabs(log: DataFrame, items: DataFrame) -> Vocabs:
    """Ranking's vocabularies count training exposures and look at no label; the history's is the catalog of retrieval."""
    shown = log.where("split = 'train' AND video_id IS NOT NULL").select("video_id", "author_id")
    tags = shown.join(items.select("video_id", F.explode(encoding.tags("tag", False, " ")).alias("t")), "video_id")
    old = log.where("split IN ('warmup', 'train')")
    return Vocabs(*[encoding.vocabulary(_count(rows, c, least)).select("id", "index") for rows, c, least in ((shown, "video_id", 35), (shown, "author_id", 220), (tags, "t", 1), (old, "video_id", 50))])


def item_static(items: DataFrame, authors: DataFrame, v: Vocabs) -> DataFrame:
    """(video_id, video, author, tags, duration_ms, upload, five flags) of all videos.

    Tags keep their order and repeats and leave out unknown ones, a video without is an empty list; what is unknown is
    index 1 and flag 0; duration and upload date stay null where they are missing.
    """
    placed = items.select("video_id", F.posexplode(encoding.tags("tag", False, " ")).alias("pos", "id")).join(v.tag, "id")
    lists = placed.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "index"))), lambda x: x["index"]).alias("tags"))
    j = items.join(authors, "video_id", "left").join(v.video.select(F.col("id").alias("video_id"), F.col("index").alias("_v")), "video_id", "left")
    j = j.join(v.author.select(F.col("id").alias("author_id"), F.col("index").alias("_a")), "author_id", "left").join(lists, "video_id", "left")
    flags = [F.col(c).isNotNull().cast("int").alias(f"{name}_known") for name, c in (("video_id", "_v"), ("author", "_a"), ("tag", "tags"), ("duration", "duration_ms"), ("upload_date", "upload"))]
    one = F.lit(encoding.OOV)
    return j.select("video_id", F.coalesce("_v", one).alias("video"), F.coalesce("_a", one).alias("author"), F.coalesce("tags", F.array().cast("array<int>")).alias("tags"), "duration_ms", "upload", *flags)


_FLAGS = [f"{c}_known" for c in ("video_id", "author", "tag", "duration", "upload_date")]


def _channel_rows(log: DataFrame, items: DataFrame, v: Vocabs) -> DataFrame:
    """Kept rows with the ids and numbers of all static channels; a video that the side table lacks is all unknown."""
    kept = log.where(_KEPT).drop("duration_ms")
    authors = log.where("video_id IS NOT NULL").select("video_id", "author_id").dropDuplicates(["video_id"])
    static = item_static(items, authors, v)
    positives = log.where(retrieval.positive(["is_click", "long_view"]) & F.col("video_id").isNotNull()).select("user_id", "time_ms", "video_id").distinct()
    hist = history.map_history(history.strict_history(kept, positives, n=20), v.history, ["user_id", "time_ms"]).select("user_id", "time_ms", "hist_idx")
    j = kept.join(static, "video_id", "left").join(hist, ["user_id", "time_ms"], "left")
    one, empty = F.lit(encoding.OOV), F.array().cast("array<int>")
    day = windows.as_date("date")
    age = F.when(F.col("upload").isNull(), 0.0).otherwise(F.log1p(F.greatest(F.datediff(day, "upload"), F.lit(0)).cast("double")))
    hist_idx = F.coalesce("hist_idx", empty)
    return j.select(
        *kept.columns, F.coalesce("video", one).alias("video"), F.coalesce("author", one).alias("author"), F.coalesce("tags", empty).alias("tags"), hist_idx.alias("hist_idx"),
        guards.hour_of(F.col("hourmin")).alias("hour"), "duration_ms", age.alias("age"), F.log1p(F.size(F.filter(hist_idx, lambda i: i > encoding.OOV)).cast("double")).alias("hist_len"), F.size(F.coalesce("tags", empty)).cast("double").alias("tag_len"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in _FLAGS],
    )


@query(f"""WITH {EV}, {_ITEMS}, {_VOCABS}, au AS (SELECT video_id, any_value(author_id) AS author_id FROM lg WHERE video_id IS NOT NULL GROUP BY 1),
tl AS (SELECT video_id, string_agg(CAST(ix AS VARCHAR), ',' ORDER BY pos) AS tags, count(*) AS n FROM tt JOIN vt USING (t) GROUP BY 1),
st AS (SELECT it.video_id, vv.ix AS v, va.ix AS a, tl.tags, tl.n, duration_ms, upload FROM it LEFT JOIN au ON au.video_id = it.video_id LEFT JOIN vv ON vv.video_id = it.video_id LEFT JOIN va ON va.author_id = au.author_id LEFT JOIN tl ON tl.video_id = it.video_id),
pos AS (SELECT DISTINCT user_id, time_ms, video_id FROM lg WHERE (is_click = 1 OR long_view = 1) AND video_id IS NOT NULL),
h AS (SELECT s.event_id, list(coalesce(vh.ix, 1) ORDER BY pos.time_ms DESC, pos.video_id DESC)[1:20] AS hist FROM lg s JOIN pos ON pos.user_id = s.user_id AND pos.time_ms < s.time_ms LEFT JOIN vh ON vh.video_id = pos.video_id WHERE s.{_KEPT} GROUP BY 1),
md AS (SELECT median(duration_ms) AS med, avg(ln(1 + duration_ms)) AS m, stddev_samp(ln(1 + duration_ms)) AS s FROM it)
SELECT s.event_id, CAST(coalesce(v, 1) AS INT) AS video, CAST(coalesce(a, 1) AS INT) AS author, coalesce(st.tags, '') AS tags, coalesce(array_to_string(hist, ','), '') AS hist, CAST(s.hourmin // 100 AS INT) AS hour, round((ln(1 + coalesce(duration_ms, med)) - m) / md.s, 6) AS duration,
round(CASE WHEN upload IS NULL THEN 0.0 ELSE ln(1 + greatest(s.day - upload, 0)) END, 6) AS age, round(ln(1 + len(list_filter(coalesce(hist, []), lambda x: x > 1))), 6) AS hist_len, CAST(coalesce(st.n, 0) AS DOUBLE) AS tag_len,
{_known('v')} AS video_id_known, {_known('a')} AS author_known, {_known('st.n')} AS tag_known, {_known('duration_ms')} AS duration_known, {_known('upload')} AS upload_date_known
FROM lg s CROSS JOIN md LEFT JOIN st ON st.video_id = s.video_id LEFT JOIN h ON h.event_id = s.event_id WHERE s.{_KEPT}""")
def ranking_channels(spark, sf):
    """Static channels of every sample: indices by ranking's own vocabularies, masked history, age on the day, five flags."""
    log, items = _log(spark, sf), _items(spark, sf)
    rows = _channel_rows(log, items, _vocabs(log, items))
    made = spec.fit(items, {"duration_ms": "numeric"})
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("event_id", "video", "author", joined("tags").alias("tags"), joined("hist_idx").alias("hist"), "hour", F.round(spec.expression(made, "duration_ms"), 6).alias("duration"), F.round("age", 6).alias("age"), F.round("hist_len", 6).alias("hist_len"), "tag_len", *_FLAGS)


# ---- training

@dataclass
class Data:
    """Rows of all splits with lookups as three arrays, dense input and labels; ``number`` is dense within the training split."""

    rows: DataFrame
    layout: ranking.Layout
    tables: DataFrame
    n: int


_PAIR = ["is_click", "long_view", "is_like"]
_ZERO = ("naive", "trend", "flag")


def _cold(made: spec.Spec, columns: list[str]):
    """The encoded values of a row that has none of ``columns``."""
    value = {c: np.log1p(made.numbers[f"{c}_fill"]) - made.numbers[f"{c}_mean"] if made.kinds[c] in spec.SCALED else made.numbers[f"{c}_fill"] for c in columns}
    return F.array(*[F.lit(float(v / made.numbers[f"{c}_std"] if made.kinds[c] in spec.SCALED else v)).cast("float") for c, v in value.items()])


def ranking_data(spark, sf, stage: Stage, windows_of: tuple[int, ...] = (1, 3, 7)) -> Data:
    """All thirteen channels: history, item, author, tags, user, item and pair features of the days before, static user
    numbers and categories, scene, hour, numbers and flags."""
    log, items = stage.write(_log(spark, sf).drop("value"), "log"), _items(spark, sf)
    vocabs = Vocabs(*[stage.write(v, f"vocab_{i}") for i, v in enumerate(_vocabs(log, items).all())])
    first = stage.write(order.numbered(log.where("split = 'train'").select("event_id"), [F.col("event_id")], "number", 0), "numbers")
    channels = _channel_rows(log, items, vocabs).join(first, "event_id", "left").withColumn("number", F.coalesce(F.col("number").cast("long"), F.col("event_id")))
    rows = channels = stage.write(channels, "channels")
    prior = stage.write(windows.priors(log, list(LABELS)), "priors")
    means = prior.first().asDict()
    exprs, names = {}, {}
    for prefix, keys, other, labels, rates, ws in (("u", ["user_id"], "video_id", list(LABELS), list(LABELS), list(windows_of)), ("i", ["video_id"], "user_id", list(LABELS), list(LABELS), list(windows_of)), ("p", ["user_id", "author_id"], "video_id", _PAIR, _PAIR[:2], [3, 7])):
        rolled = windows.rolling(log, keys, other, labels, rates, ws, prior, prefix, need=channels.select(*keys, "date"))
        columns = [c for c in rolled.columns if c.startswith(f"{prefix}_") and not (prefix == "p" and encoding.classify(c) == "naive")]
        rolled = stage.write(rolled.select(*keys, "date", *columns), f"rolled_{prefix}")
        kinds = {c: "zero" if encoding.classify(c) in _ZERO else encoding.classify(c) for c in columns}
        fills = {c: next(means[f"g_{x}"] for x in labels if f"_{x}_smooth_" in c) for c, k in kinds.items() if k == "smooth"}
        made = spec.fit(channels.where("split = 'train'").select(*keys, "date").join(rolled, [*keys, "date"], "left"), kinds, fills)
        # encoded by key and day, of which there are fewer than rows; a row without history takes the values of null. Spark takes
        # an array for one number and would broadcast all features, so the join is by merge
        exprs[prefix] = F.coalesce(f"x_{prefix}", _cold(made, columns))
        rows = rows.hint("merge").join(rolled.select(*keys, "date", F.array(*[spec.expression(made, c).cast("float") for c in columns]).alias(f"x_{prefix}")), [*keys, "date"], "left")
        names[prefix] = tuple(columns)
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.greatest("c_acctbal", F.lit(0)).alias("balance"), "c_mktsegment", "c_nationkey")
    made = spec.fit(users, {"balance": "numeric", "c_mktsegment": "category", "c_nationkey": "category"})
    users = spec.apply(users, made, "user_id")
    rows = rows.join(users, "user_id", "left")
    duration = spec.fit(items, {"duration_ms": "numeric"})
    numbers = [F.coalesce("balance", F.lit(0.0)).alias("balance")]
    numeric = [spec.expression(duration, "duration_ms").alias("duration"), *[F.col(c) for c in ("age", "hist_len", "tag_len")]]
    layout = ranking.Layout([
        ranking.Embedded("hist_pool", "history", 8), ranking.Embedded("item_id", "item", 8), ranking.Embedded("author", "author", 4), ranking.Embedded("tag_pool", "tag", 4),
        ranking.Dense("user_t1", names["u"]), ranking.Dense("item_t1", names["i"]), ranking.Dense("pair", names["p"]), ranking.Dense("user_static_num", ("balance",)),
        ranking.Embedded("segment", "segment", 2), ranking.Embedded("nation", "nation", 4), ranking.Embedded("tab", "tab", 4), ranking.Embedded("hour", "hour", 4),
        ranking.Dense("numeric", ("duration", "age", "hist_len", "tag_len")), ranking.Dense("flags", tuple(_FLAGS)),
    ])
    ids = {"hist_pool": ranking.listed(F.col("hist_idx")), "item_id": F.col("video"), "author": F.col("author"), "tag_pool": ranking.listed(F.col("tags")), "segment": F.col("c_mktsegment") + 1, "nation": F.col("c_nationkey") + 1, "tab": F.col("tab") + 2, "hour": F.col("hour") + 2}
    dense = F.concat(*[exprs[p] for p in "uip"], F.array(*[e.cast("float") for e in (*numbers, *numeric, *[F.col(c) for c in _FLAGS])]))
    # a history's unknown items are masked, a tag list's padding only
    look = layout.slim_lookups(ids, masked=(encoding.PAD, encoding.OOV))
    packed = rows.select("event_id", "user_id", "split", "number", *LABELS, *look, dense.alias("x"), F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")) for c in LABELS]).alias("y"))
    spans = {"segment": 6, "nation": 26, "tab": 6, "hour": 25}
    vectors = [v.select(F.lit(t).alias("table"), F.col("index").cast("long").alias("id")) for t, v in (("history", vocabs.history), ("item", vocabs.video), ("author", vocabs.author), ("tag", vocabs.tag))]
    vectors += [spark.range(1, top + 1).select(F.lit(t).alias("table"), "id") for t, top in spans.items()]
    every = vectors[0]
    for x in vectors[1:]:
        every = every.unionByName(x)
    return Data(packed, layout, stage.write(ranking.fresh_tables(every, layout.widths, SEED), "fresh"), first.count())


def models(features: int, tasks: int) -> dict[str, multitask.Net]:
    """The five that are compared, over the same input."""
    return {
        "single": multitask.Mixture(features, multitask.single(tasks)), "mmoe": multitask.Mixture(features, multitask.mmoe(tasks, 4)), "cgc": multitask.Mixture(features, multitask.cgc(tasks, 2)),
        "ple": multitask.Stacked(features, tasks), "selective": multitask.Selective(features, tasks),
    }


def _scaled(net: multitask.Net) -> multitask.Net:
    """A start for wide inputs: weights shrunk by the square root of their number of inputs."""
    return net.at(net.flat / np.sqrt(max(1, next(iter(net.shapes.values()))[0] / 8)))


@query()
def ranking_embedded_auc(spark, sf):
    """AUC on test of every task for the five models over all thirteen channels, trained for an epoch of mini-batches with
    hidden ids (no SQL: training)."""
    stage = Stage(spark)
    data = ranking_data(spark, sf, stage)
    nets = {name: _scaled(net) for name, net in models(data.layout.size, len(LABELS)).items()}
    made = ranking.train_by_parts(data.rows.where("split = 'train'"), data.tables, nets, data.layout, data.n, BATCH, 1, SEED, 0.02, ("item_id", 0.1, "video_id_known"), stage)
    p = stage.write(ranking.predict_models(data.rows.where("split = 'test'"), made, data.layout, list(LABELS), stage).withColumn("y", F.col("y").cast("int")), "predictions")
    return metrics.auc(p, ["model", "task"]).select("model", "task", "n", "pos", F.round("auc", 4).alias("auc"))


@query("SELECT CAST(NULL AS VARCHAR) AS side, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS position WHERE false")
def training_is_bit_equal(spark, sf):
    """Runs of weights that differ between two trainings of one seed, dense layers and vectors, after saving and loading: none."""
    stage, found = Stage(spark), []
    rows = order.numbered(_log(spark, sf).where("split = 'train' AND video_id IS NOT NULL").select("event_id", "video_id", "user_id", *LABELS), [F.col("event_id")], "number", 0)
    layout = ranking.Layout([ranking.Embedded("item_id", "item", 4), ranking.Embedded("user", "user", 4), ranking.Dense("one", ("one",))])
    look = layout.lookups({"item_id": F.col("video_id") + 2, "user": F.col("user_id") + 2})
    packed = stage.write(rows.select(F.col("number").cast("long").alias("number"), look.alias("look"), F.array(F.lit(1.0)).alias("x"), F.array(*[F.col(c).cast("double") for c in LABELS]).alias("y")), "rows")
    n = packed.count()
    for _ in range(2):
        mine = Stage(spark)
        ids = packed.select(F.explode("look").alias("l")).select("l.table", "l.id").distinct()
        made = ranking.train(packed, ranking.fresh_tables(ids, layout.widths, SEED), multitask.Mixture(layout.size, multitask.mmoe(len(LABELS), 2)), layout, n, -(-n // 2), 1, SEED, 0.05, stage=mine)
        saved = weights.as_table(spark, {k: np.array(x) for k, x in made.net.w.items()})
        for t in layout.widths:
            saved = saved.unionByName(weights.embedding_rows(made.tables.where(F.col("table") == t), f"table_{t}", "id", "w"))
        path = f"{mine.root}/weights"
        weights.save(saved, path)
        found.append(weights.load(spark, path))
    return weights.differences(*found)
