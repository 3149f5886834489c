"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document starts with rate 1. The mix wants the rates closest to that, in relative entropy, that reach the target T_s
of every source s in words, n_d being the words of document d:

    minimise  sum_d (r_d ln r_d - r_d)   subject to   sum_{d in s} n_d r_d = T_s  and  r_d <= MOST.

The dual is convex, and its solution is an exponential tilt of each document, r_d = min(MOST, exp(lambda_s n_d / m_s)),
with m_s the mean size, for scale. Its derivative in lambda_s, the words taken less T_s, only grows, so Newton steps

    lambda_s <- lambda_s - (sum n_d r_d - T_s) / sum_{r_d < MOST} (n_d / m_s) n_d r_d

are kept between the nearest values known to take too few and too many; a step that leaves them goes to their middle, or
twice as far where one is not known yet. Each is an aggregation over the table of (source, size, documents), which stands
for the documents without loss. Where T_s is all that MOST copies give, every rate is MOST.

Rates become whole copies by running sums over each source's sizes, from large to small, with a start that a hash of the
source gives: a size gets as many copies as whole numbers its part of the sum crosses. As sizes only fall, the words then
differ from the target by less than the largest document. What is missing or too much is made up by sizes that fit in it,
the largest first, until nothing that fits can move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm._shared import materialize

#: Weights dealt to the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
#: A source, and a document, is taken at most so many times.
MOST = 3
#: Newton ends when no source is further from its target than this share.
CLOSE = 1e-6
#: The documents of one source and size are told apart in so many groups by a hash.
SALTS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target double) for ``sizes(source, source_size)``, one row for each source.

    Sources in code point order, null last, take the weights in turn. The targets share the total of all sizes by
    weight, but none is above ``most`` times its source's size: the excess is shared again among the others. In closed
    form, with the sources in the order of size over weight, the first k are at their cap where k is the least number
    for which the water level, what is left over the weights left, is no higher than the next source's cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.array(*map(F.lit, weights))
    w = sizes.withColumn("weight", F.element_at(dealt, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    left = w.withColumn("level_num", total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("level_den", F.sum("weight").over(after))
    fits = left.withColumn("fits", F.col("level_num") * F.col("weight") <= most * F.col("source_size") * F.col("level_den"))
    at = fits.withColumn("n", F.row_number().over(by_ratio)).withColumn("level", F.min(F.when(F.col("fits"), F.struct("n", "level_num", "level_den"))).over(everything))
    wanted = F.col("weight") * F.col("level.level_num") / F.col("level.level_den")
    capped = F.col("level").isNull() | (F.col("n") < F.col("level.n"))
    cap = (most * F.col("source_size")).cast("double")
    return at.select("source", "source_size", F.when(capped, cap).otherwise(F.least(wanted, cap)).alias("target"))


def _rate(size: str, most: int) -> Column:
    """The rate of a document of ``size`` words, given its source's tilt; what takes everything has no tilt."""
    return F.when(F.col("every"), F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col(size) / F.col("mean"), F.lit(50.0))), F.lit(float(most))))


def balance(groups: DataFrame, wanted: DataFrame, most: int = MOST, most_steps: int = 80) -> DataFrame:
    """(source, tilt, mean, every): the dual solution for ``groups(source, size, docs)`` and ``wanted(source, target)``.

    Sources without words, or with target 0, have no row: nothing of them is taken. Each Newton step is one aggregation
    by source; its result is written to the shared folder. Only the largest relative error, one number, reaches the driver.
    """
    means = groups.where("size > 0").groupBy(F.col("source").alias("_s")).agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"), F.sum(F.col("size") * F.col("docs")).alias("words"))
    at = wanted.where("target > 0").join(means, F.col("source").eqNullSafe(F.col("_s"))).select("source", "target", "mean", (F.col("target") >= F.col("words") * most * (1 - CLOSE)).alias("every"))
    at = materialize(at.select("*", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")).coalesce(1), "tilt")
    for _ in range(most_steps):
        there = groups.where("size > 0").join(at.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        words = F.col("size") * F.col("docs") * F.col("rate")
        state = [F.first(c).alias(c) for c in ("target", "mean", "every", "tilt", "low", "high")]
        mass = there.withColumn("rate", _rate("size", most)).groupBy("source").agg(*state, F.sum(words).alias("mass"), F.sum(F.when(F.col("rate") < most, words * F.col("size") / F.col("mean"))).alias("slope"))
        over = F.col("mass") > F.col("target")
        mass = mass.withColumn("error", F.when(F.col("every"), 0.0).otherwise(F.abs(F.col("mass") / F.col("target") - 1)))
        mass = mass.withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
        newton = F.col("tilt") - (F.col("mass") - F.col("target")) / F.col("slope")
        outward = F.when(F.col("high").isNull(), F.greatest(2 * F.col("low"), F.col("low") + 1)).when(F.col("low").isNull(), F.least(2 * F.col("high"), F.col("high") - 1))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, outward)
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("tilt")) < 20)
        step = F.when(F.col("error") <= CLOSE, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle)
        at = materialize(mass.select("source", "target", "mean", "every", step.alias("tilt"), "low", "high", "error").coalesce(1), "tilt")  # a row for each source
        worst = at.agg(F.max("error")).first()[0]
        if worst is None or worst <= CLOSE:
            return at.select("source", "tilt", "mean", "every")
    raise RuntimeError(f"Newton did not converge in {most_steps} steps")


def _rounded(groups: DataFrame, wanted: DataFrame, rates: DataFrame, most: int, most_rounds: int = 40) -> DataFrame:
    """(source, size, docs, copies): whole copies for all documents of each size, together near the source's target.

    The window is over the distinct sizes of a source, not its documents. Each round of making up moves one size of every
    source, by as many copies as fit; a round is an aggregation over the sizes, written to the shared folder.
    """
    rated = groups.where("size > 0").join(rates.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    share = F.least(F.col("docs") * _rate("size", most), F.col("docs") * F.lit(float(most)))
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    upto = F.floor(F.round(F.sum("share").over(down), 6) + start)
    crossed = rated.withColumn("share", share).withColumn("upto", upto)
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy(F.desc("size"))), F.lit(0))
    made = crossed.select("source", "size", "docs", F.least(F.greatest(F.col("upto") - before, F.lit(0)), most * F.col("docs")).cast("long").alias("copies"))
    made = materialize(made, "copies")
    for _ in range(most_rounds):
        taken = made.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
        miss = taken.join(wanted.select("source", "target"), F.col("_s").eqNullSafe(F.col("source"))).select("_s", (F.round("target") - F.col("words")).cast("long").alias("miss"))
        there = made.join(miss, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        room = F.when(F.col("miss") > 0, most * F.col("docs") - F.col("copies")).otherwise(F.col("copies"))
        moved = F.least(F.floor(F.abs("miss") / F.col("size")), room)
        fitting = F.when(moved > 0, F.col("size"))
        picked = there.withColumn("moved", moved).withColumn("pick", fitting == F.max(fitting).over(Window.partitionBy("source")))
        change = F.when(F.coalesce("pick", F.lit(False)), F.col("moved") * F.signum("miss")).otherwise(0).cast("long")
        made = materialize(picked.select("source", "size", "docs", (F.col("copies") + change).alias("copies"), change.alias("change")), "copies")
        if made.where("change <> 0").isEmpty():
            return made.drop("change")
        made = made.drop("change")
    return made


def _content(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's columns; those that Spark can't hash are left out."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*cols).alias("h1"), F.hash(*cols).alias("h2")


def _planned(rows: DataFrame, wanted: Callable[[DataFrame], DataFrame] | None, most: int) -> DataFrame:
    """Add ``source_size, target, n`` (copies) to ``rows(doc_id, source, size, h1, h2)``."""
    sized = materialize(rows, "sizes")
    groups = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "groups")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    aims = materialize((wanted or targets)(sources).coalesce(1), "targets")  # a row for each source
    shares = _rounded(groups, aims, balance(groups, aims, most), most)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    shares = groups.join(shares.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "copies"), same("source", "_s") & same("size", "_z"), "left").drop("_s", "_z")
    shares = shares.join(aims.withColumnRenamed("source", "_s"), same("source", "_s")).drop("_s")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(SALTS)).cast("int"))
    ahead = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n")).select("source", "size", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    plan = shares.join(offsets.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "salt", "ahead"), same("source", "_s") & same("size", "_z")).drop("_s", "_z")
    plan = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_t"), "docs", "ahead", "copies", "source_size", "target")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", "h1", "h2")))
    out = ranked.join(plan, same("source", "_s") & (F.col("size") == F.col("_z")) & (F.col("salt") == F.col("_t")))
    base = F.floor(F.coalesce("copies", F.lit(0)) / F.col("docs"))
    odd = F.coalesce("copies", F.lit(0)) - base * F.col("docs")
    return out.withColumn("n", (base + F.when(F.col("ahead") + F.col("rank") <= odd, 1).otherwise(0)).cast("long"))


def copies(docs: DataFrame, wanted: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): a row for each row of ``docs``.

    ``taken`` is ``copies`` times ``size``; no document is taken more than ``most`` times. Documents of one size in one
    source have one rate: each gets the whole share of their copies, and the first in the order of a hash get one more.
    Null texts have size 0 and are taken 0 times, as are all documents without words; null is a source of its own, the
    last; an empty table gives no rows. Rows that repeat a doc_id count each; they are told apart by their text, so reruns
    agree.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(id_col, text, source).alias("h1"), F.hash(id_col, text, source).alias("h2"))
    return _planned(rows, wanted, most).select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"), F.col("n").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns are kept, whatever their names.

    Rows are told apart by two hashes of their columns (96 bits); equal rows share their copies.
    """
    h1, h2 = _content(docs)
    packed = docs.select(F.struct("*").alias("row"), size_of(text).alias("size"), h1, h2)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"), h1, h2)
    n = _planned(rows, None, MOST).groupBy("h1", "h2", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where("n > 0")
    joined = packed.join(n, ["h1", "h2", "size"])
    rank = F.row_number().over(Window.partitionBy("h1", "h2", "size").orderBy(F.lit(0)))  # equal rows: any order will do
    times = (F.floor(F.col("n") / F.col("rows")) + F.when(F.col("rank") <= F.pmod("n", "rows"), 1).otherwise(0)).cast("int")
    repeated = joined.withColumn("rank", rank).where(times > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times)))
    return repeated.select("row.*")
