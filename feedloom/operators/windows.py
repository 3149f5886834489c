"""T-1 rolling features: what happened in the days before a target day, never on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 20.0


def as_date(yyyymmdd: str) -> Column:
    return F.to_date(F.col(yyyymmdd).cast("string"), "yyyyMMdd")


def as_int(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd").cast("int")


def daily(log: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Impressions and label sums for each key and day."""
    return log.groupBy(*keys, "date").agg(F.count("*").alias("imp"), *[F.sum(c).alias(c) for c in labels])


def project(days: DataFrame, width: int) -> DataFrame:
    """Each day's row once for every target day that sees it: ``offset`` 1 to ``width`` days later."""
    off = days.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(width))))
    return off.withColumn("target", as_int(F.date_add(as_date("date"), F.col("offset"))))


def priors(log: DataFrame, labels: list[str]) -> DataFrame:
    """One row: each label's mean over the warm-up split."""
    return log.where("split = 'warmup'").agg(*[F.avg(c).alias(f"g_{c}") for c in labels])


def rolling(log: DataFrame, keys: list[str], other: str, labels: list[str], rates: list[str], windows: list[int], prior: DataFrame, prefix: str, need: DataFrame | None = None, last: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """Windowed counts, distinct partners, plain and smoothed rates, trend and a history flag for key and target day.

    A row stands for every target day within reach of any activity, on quiet days too. ``need(keys, date)`` names the
    wanted ones; ``last`` clips target days. A key's days, as many as the calendar has, lie in one line with its targets
    and are summed by ranges of it, so no day is copied to the days that see it. A plain rate without impressions is null;
    a smoothed one falls back to the prior; the trend compares the last day with the daily mean of the widest window.
    """
    widest = max(windows)
    of = {f"_k{i}": F.col(k) for i, k in enumerate(keys)}
    day = F.unix_date(as_date("date"))
    rows = log.where("date IS NOT NULL").select(*[c.alias(n) for n, c in of.items()], day.alias("_day"), *[F.col(c).alias(f"_s{i}") for i, c in enumerate(labels)], F.col(other).alias("_other"))
    zero = {f"_s{i}": F.lit(None).cast("long") for i in range(len(labels))}

    def line(df: DataFrame, **given: Column) -> DataFrame:
        made = {"_imp": F.lit(None).cast("long"), **zero, "_more": F.lit(None).cast("long"), "_asked": F.lit(None).cast("int"), **given}
        return df.select(*of, "_day", *[v.alias(n) for n, v in made.items()])

    # a partner counts from the day after until it is seen again or leaves the widest window: one up, one down
    seen = rows.where("_other IS NOT NULL").select(*of, "_other", "_day").distinct()
    again = F.lead("_day").over(Window.partitionBy(*of, "_other").orderBy("_day"))
    ends = seen.withColumn("_end", F.least(F.coalesce(again, F.col("_day") + widest), F.col("_day") + widest) + 1)
    steps = ends.select(*of, F.explode(F.array(F.struct((F.col("_day") + 1).alias("_day"), F.lit(1).cast("long").alias("_by")), F.struct(F.col("_end").alias("_day"), F.lit(-1).cast("long").alias("_by")))).alias("_x")).select(*of, "_x.*")
    if need is None:
        asked = rows.select(*of, "_day").distinct().select(*of, F.explode(F.sequence(F.col("_day") + 1, F.col("_day") + widest)).alias("_day"))
    else:
        asked = need.select(*[c.alias(n) for n, c in of.items()], day.alias("_day")).dropna().distinct()
    shown = line(rows, _imp=F.lit(1).cast("long"), **{f"_s{i}": F.col(f"_s{i}").cast("long") for i in range(len(labels))})
    every = shown.unionByName(line(steps, _more=F.col("_by"))).unionByName(line(asked, _asked=F.lit(1)))
    values = ["_imp", *zero]
    days = every.groupBy(*of, "_day").agg(*[F.sum(c).alias(c) for c in (*values, "_more")], F.max("_asked").alias("_asked"))
    back = Window.partitionBy(*of).orderBy("_day")
    names = dict(zip(values, ("imp", *labels), strict=True))
    sums = {f"{prefix}_{names[c]}_{w}d": F.coalesce(F.sum(c).over(back.rangeBetween(-w, -1)), F.lit(0)) for w in windows for c in values}
    active = F.coalesce(F.sum((F.col("_imp") > 0).cast("long")).over(back.rangeBetween(-widest, -1)), F.lit(0))
    known = F.coalesce(F.sum("_more").over(back.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))
    found = days.select(*of, "_day", "_asked", *[v.alias(n) for n, v in sums.items()], active.alias(f"{prefix}_active_days_{widest}d"), known.alias(f"{prefix}_distinct_{widest}d"))
    found = found.where((F.col("_asked") == 1) & (F.col(f"{prefix}_active_days_{widest}d") > 0)).withColumn("target", as_int(F.date_from_unix_date("_day")))
    if last is not None:
        found = found.where(F.col("target") <= last)
    out = found.select(*[F.col(n).alias(k) for n, k in zip(of, keys, strict=True)], "target", *sums, f"{prefix}_active_days_{widest}d", f"{prefix}_distinct_{widest}d").crossJoin(F.broadcast(prior))
    for w in windows:
        imp = F.col(f"{prefix}_imp_{w}d")
        for c in rates:
            num = F.col(f"{prefix}_{c}_{w}d")
            out = out.withColumn(f"{prefix}_{c}_rate_{w}d", F.when(imp > 0, num / imp)).withColumn(f"{prefix}_{c}_smooth_{w}d", (num + alpha * F.col(f"g_{c}")) / (imp + alpha))
    if 1 in windows and widest > 1:
        base = F.col(f"{prefix}_imp_{widest}d") / widest
        out = out.withColumn(f"{prefix}_trend", F.when(base > 0, F.col(f"{prefix}_imp_1d") / base))
    return out.drop(*[f"g_{c}" for c in labels]).withColumn(f"{prefix}_has_history", F.lit(1)).withColumnRenamed("target", "date")


def pair_defaults(features: DataFrame, prior: dict[str, float], prefix: str, rates: list[str]) -> DataFrame:
    """After a left join: counts and the flag become 0, smoothed rates the prior."""
    fill = {}
    for c in features.columns:
        if c.startswith(f"{prefix}_"):
            smooth = next((r for r in rates if f"_{r}_smooth_" in c), None)
            fill[c] = prior[smooth] if smooth else 0
    return features.fillna(fill)
