"""Guards that stop a run: conditions are tested in the pass that reads the rows anyway, never in a scan of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedloom.operators import metrics
from feedloom.operators.metrics import ranking_at


def or_raise(ok: Column, value: Column, kind: str, *said: Column | str) -> Column:
    """``value`` where ``ok`` is true; else the query stops with the text of ``said``. A null condition stops it too."""
    text = F.concat(*[F.coalesce(x.cast("string"), F.lit("null")) if isinstance(x, Column) else F.lit(x) for x in said])
    return F.when(ok, value).otherwise(F.raise_error(text).cast(kind))


def only(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``rows``, all of them; the query stops at the first row for which a condition doesn't hold, naming it."""
    out = rows
    for name, ok in conditions.items():
        out = out.where(or_raise(ok, F.lit(True), "boolean", f"guard {name} fails"))
    return out


class Watched:
    """Rows whose violations are counted while they pass: ``rows`` goes on as usual, ``verify`` after an action raises
    if any condition of ``bad`` held for a row. No row is read twice and no job is added."""

    def __init__(self, rows: DataFrame, bad: dict[str, Column]):
        self._seen, self._names = Observation(), list(bad)
        self.rows = rows.observe(self._seen, *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in bad.items()])

    def violations(self) -> dict[str, int]:
        """Rows that broke each condition; waits for the first action over ``rows``."""
        got = self._seen.get
        return {name: got[name] for name in self._names}

    def verify(self) -> None:
        broken = {k: n for k, n in self.violations().items() if n}
        if broken:
            raise ValueError("guards: " + ", ".join(f"{k} ({n} rows)" for k, n in broken.items()))


def checked_ks(ks: list[int], longest: int) -> list[int]:
    """The cut-offs in ascending order; none, repeated ones, and such below 1 or beyond the answers' length are errors."""
    if not ks:
        raise ValueError("no k is given")
    if len(set(ks)) != len(ks):
        raise ValueError(f"k is repeated: {ks}")
    if min(ks) < 1 or max(ks) > longest:
        raise ValueError(f"every k lies between 1 and {longest}, the length of the answers: {ks}")
    return sorted(ks)


def retrieval_metrics(answers: DataFrame, targets: DataFrame, request: list[str], ks: list[int], longest: int, item: str = "item_id") -> DataFrame:
    """``ranking_at`` of ``answers(request..., item, rank)`` against ``targets(request..., item)``, whose rows are checked
    where they are grouped.

    A request whose targets repeat, or whose answer repeats an item or a rank, isn't numbered from 1, or is longer than
    ``longest`` stops the query. A request without an answer counts as nothing found; an answer to no request stops it.
    """
    ks = checked_ks(ks, longest)
    wanted = targets.groupBy(*request).agg(F.collect_list(item).alias("_t"))
    n = F.size("_t")
    wanted = wanted.withColumn("n_targets", or_raise(n == F.size(F.array_distinct("_t")), n, "int", "a target repeats in a request"))
    given = answers.groupBy(*request).agg(F.collect_list(F.struct(F.col(item).alias("item"), F.col("rank").cast("int").alias("rank"))).alias("_a"))
    m, ranks = F.size("_a"), F.transform("_a", lambda x: x["rank"])
    apart = (F.size(F.array_distinct(F.transform("_a", lambda x: x["item"]))) == m) & (F.size(F.array_distinct(ranks)) == m)
    whole = (F.array_min(ranks) == 1) & (F.array_max(ranks) == m) & (m <= longest)
    kind = given.schema["_a"].dataType.simpleString()
    counted = or_raise(whole, F.col("_a"), kind, "ranks of an answer don't run from 1 to its length, at most the longest")
    given = given.withColumn("_a", F.when(apart, counted).otherwise(F.raise_error(F.lit("an item or a rank repeats in an answer")).cast(kind)))
    both = given.join(wanted, request, "full").withColumn("_t", or_raise(F.col("n_targets").isNotNull(), F.col("_t"), wanted.schema["_t"].dataType.simpleString(), "an answer to no request"))
    hits = both.select(*request, "n_targets", F.explode("_t").alias("_i"), "_a")
    place = F.element_at(F.filter("_a", lambda x: x["item"] == F.col("_i")), 1)
    found = hits.select(*request, "n_targets", F.when(F.exists("_a", lambda x: x["item"] == F.col("_i")), place["rank"]).alias("rank"))
    return ranking_at(found, request, ks)


def log_q_of(rows: DataFrame, q: DataFrame, item: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``rows`` with ``log_q`` of their ``item`` from ``q(item, log_q)``.

    An item beyond the catalog's range of indices, or without support in ``q``, stops the query: in-batch negatives are
    training targets, so a missing one says that the shares come from other rows. Nothing is put in its place.
    """
    j = rows.join(q.select(item, F.col("log_q").alias("_q")), item, "left")
    value = or_raise(F.col("_q").isNotNull(), F.col("_q"), "double", "no support for item ", F.col(item))
    if low is not None or high is not None:
        inside = F.lit(True)
        inside = inside & (F.col(item) >= low) if low is not None else inside
        inside = inside & (F.col(item) <= high) if high is not None else inside
        value = F.when(inside, value).otherwise(or_raise(F.lit(False), F.lit(None).cast("double"), "double", "outside the catalog: item ", F.col(item)))
    return j.withColumn("log_q", value).drop("_q")


def same_rows(samples: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """``samples`` with the columns of ``features``, row for row by ``key``: a row that one side lacks, or that a side has
    twice, stops the query. The counts are those of the join's own groups."""
    mine = samples.select(key, F.struct(*samples.columns).alias("_s")).groupBy(key).agg(F.collect_list("_s").alias("_s"))
    rest = [c for c in features.columns if c != key]
    theirs = features.select(key, F.struct(*rest).alias("_f")).groupBy(key).agg(F.collect_list("_f").alias("_f"))
    both = mine.join(theirs, key, "full")
    ok = (F.coalesce(F.size("_s"), F.lit(0)) == 1) & (F.coalesce(F.size("_f"), F.lit(0)) == 1)
    both = both.withColumn("_s", or_raise(ok, F.element_at("_s", 1), samples_kind(samples), "samples and features are not the same rows: ", F.col(key))).withColumn("_f", F.element_at("_f", 1))
    return both.select("_s.*", *[F.col(f"_f.{c}").alias(c) for c in rest])


def samples_kind(rows: DataFrame) -> str:
    """The rows' type as a struct, for a cast of the error."""
    return rows.schema.simpleString()


def evaluate_ranking(pred: DataFrame, user: str, score: str = "p", label: str = "y", buckets: int = 10) -> DataFrame:
    """(metric, bucket, value) of predictions: n, pos_rate, auc, gauc by impressions with the users used and skipped, pcoc,
    and for each calibration bucket its rows, mean prediction and mean outcome; ``bucket`` is null but for those.

    Scores must be finite and within [0, 1], labels 0 or 1 and no value null: the first row that isn't stops the query, in
    the pass that the metrics make. What is undefined, as the AUC of one class, is null.
    """
    p, y = F.col(score), F.col(label)
    sound = only(pred, {"label": y.isin(0, 1), "score": ~F.isnan(p) & (p >= 0) & (p <= 1), "user": F.col(user).isNotNull()})
    one = F.lit("all").alias("_all")
    overall = sound.agg(F.count("*").cast("double").alias("n"), F.avg(y.cast("double")).alias("pos_rate"), metrics.pcoc(score, label).alias("pcoc")).unpivot([], ["n", "pos_rate", "pcoc"], "metric", "value")
    area = metrics.auc(sound.select("*", one), ["_all"], score, label).select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    by_user = metrics.gauc(sound, user, score, label).select("gauc", F.col("used").cast("double").alias("gauc_users"), F.col("skipped").cast("double").alias("gauc_skipped")).unpivot([], ["gauc", "gauc_users", "gauc_skipped"], "metric", "value")
    scalars = overall.unionByName(area).unionByName(by_user).select("metric", F.lit(None).cast("int").alias("bucket"), "value")
    cal = metrics.calibration(sound, buckets, score, label).select("bucket", F.col("n").cast("double").alias("calibration_n"), F.col("mean_pred").alias("calibration_pred"), F.col("mean_label").alias("calibration_label"))
    return scalars.unionByName(cal.unpivot(["bucket"], ["calibration_n", "calibration_pred", "calibration_label"], "metric", "value").select("metric", "bucket", "value"))
