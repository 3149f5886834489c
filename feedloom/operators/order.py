"""Running sums over one global order without gathering the rows in one task.

Rows are cut into slices of the order at quantiles of a sample, summed within their slice, and each slice adds the total
of the slices before it. The sample is the keys of least hash, so it is the same in every run; it decides only how even
the slices are, never a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.stage import Stage

#: Slices of an order, and sampled keys from which their bounds are taken.
SLICES, SAMPLED = 64, 2048


def _bounds(df: DataFrame, key: list[Column], by: list[str], slices: int) -> list[tuple]:
    """Bounds of the slices, from the keys of least hash; none if the rows are fewer than the sample would hold.

    One small job: every part passes on SAMPLED keys at most, and nothing is shuffled but those.
    """
    names = [f"_{i}" for i in range(len(key))]
    keys = df.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[c.alias(n) for c, n in zip(key, names, strict=True)])
    least = [tuple(r[n] for n in names) for r in keys.orderBy(F.xxhash64(*keys.columns)).limit(SAMPLED).collect()]
    if len(least) < SAMPLED:
        return []
    rank = lambda row: tuple((v is not None, v) if v is not None else (False,) for v in row)
    least = sorted(least, key=rank)
    return list(dict.fromkeys(least[len(least) * i // slices] for i in range(1, slices)))


def _slice(df: DataFrame, key: list[Column], bounds: list[tuple]) -> Column:
    """Number of the bounds that are at most the key, in two levels: about twice the square root of their number compared.

    Nulls sort first, so a single key needs no bound at null.
    """
    kinds = [f.dataType for f in df.select(*key).schema.fields]
    if len(key) == 1:
        own, made = key[0], [F.lit(row[0]).cast(kinds[0]) for row in bounds if row[0] is not None]
    else:
        own = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(key)])
        made = [F.struct(*[F.lit(v).cast(kind).alias(f"_{i}") for i, (v, kind) in enumerate(zip(row, kinds, strict=True))]) for row in bounds]
    if not made:
        return F.lit(0)
    width = math.isqrt(len(made))
    lines = [made[i : i + width] for i in range(0, len(made), width)]
    below = lambda listed: F.size(F.filter(listed, lambda b: b <= own))
    fine, line = F.array(*[F.array(*x) for x in lines]), F.array(below(F.array(*[x[0] for x in lines])))
    return F.element_at(F.transform(line, lambda at: F.when(at > 0, (at - 1) * width + below(F.element_at(fine, at))).otherwise(0)), 1)


def sums_before(df: DataFrame, key: list[Column], sums: dict[str, Column], by: list[str] | None = None, slices: int = SLICES) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its expression over the rows before in ascending ``key``.

    ``by`` keeps separate orders. Keys should be distinct within one; rows that tie come in some order. An empty table
    stays empty. A group's rows are spread over its slices, so one large group fills many tasks; fewer rows than the
    sample holds are summed as they are. ``df`` is written first, as it is read for the bounds, the totals and the sums.
    """
    by, df = by or [], Stage(df.sparkSession).write(df, "ordered")
    bounds = _bounds(df, key, by, slices)
    if not bounds:
        whole = Window.partitionBy(*by).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(value).over(whole), F.lit(0)).alias(name) for name, value in sums.items()])
    cut = df.withColumn("_slice", _slice(df, key, bounds))
    for name, value in sums.items():
        cut = cut.withColumn(f"_v_{name}", value)
    total = cut.groupBy(*by, "_slice").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_at"), *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums])
    within = Window.partitionBy(*by, "_slice").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.select("*", *[F.coalesce(F.sum(f"_v_{name}").over(within), F.lit(0)).alias(f"_w_{name}") for name in sums])
    same = F.col("_slice") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = summed.join(start if by else F.broadcast(start), same)  # without groups a row for each slice, 64 at most
    return joined.select(*df.columns, *[(F.col(f"_w_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums])


def numbered(df: DataFrame, key: list[Column], out: str, first: int = 1) -> DataFrame:
    """``df`` with its row number in ascending ``key``, from ``first``."""
    return sums_before(df, key, {out: F.lit(1)}).withColumn(out, (F.col(out) + first).cast("int"))
