"""Exact order statistics by counting in slices: no sort, no sketch, and no task that holds the values.

A pass counts, for each column, the known values in BINS equal slices of the interval in which the wanted rank must lie,
with the least and greatest value of each slice. The slice that has the rank is the next interval; one whose least and
greatest value are equal is the answer. What comes to the driver is BINS rows a rank and pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256


def at_ranks(df: DataFrame, ranks: dict[str, list[int]], bins: int = BINS) -> dict[tuple[str, int], float]:
    """The value of each column at each rank (from 0) among its finite values, ascending; ranks beyond them are left out."""
    value = {c: F.col(c).cast("double") for c in ranks}
    known = {c: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for c, v in value.items()}
    if not ranks:
        return {}
    row = df.agg(*[x for c, v in value.items() for x in (F.count_if(known[c]), F.min(F.when(known[c], v)), F.max(F.when(known[c], v)))]).first()
    out, open_ = {}, {}
    for i, (c, rs) in enumerate(ranks.items()):
        n, low, high = row[3 * i : 3 * i + 3]
        for r in set(rs):
            if 0 <= r < n:
                if low == high:
                    out[c, r] = low
                else:
                    open_[c, r] = (low, high, 0)  # the interval, and how many values lie before it
    while open_:
        asked = sorted(open_.items(), key=str)
        part = []
        for i, ((c, _), (low, high, _)) in enumerate(asked):
            width = high / 2 - low / 2  # halves, so that it stays finite; 0 between the smallest numbers there are
            share = (value[c] / 2 - low / 2) / width if width else (value[c] > low).cast("double")
            inside = known[c] & (value[c] >= low) & (value[c] <= high)
            part.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("bin"), value[c].alias("v"))))
        counted = df.select(F.explode(F.array_compact(F.array(*part))).alias("x")).groupBy("x.i", "x.bin").agg(F.count("*").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high"))
        found: dict[int, list] = {}
        for r in counted.collect():
            found.setdefault(r["i"], []).append((r["bin"], r["n"], r["low"], r["high"]))
        for i, ((c, r), (_, _, before)) in enumerate(asked):
            for _, n, low, high in sorted(found[i]):
                if r < before + n:
                    break
                before += n
            if low == high:
                out[c, r] = low
                del open_[c, r]
            else:
                open_[c, r] = (low, high, before)
    return out


def medians(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, float | None]:
    """The median of each column's finite values, the mean of the two middle ones if their number is even; None without any."""
    if not columns:
        return {}
    value = {c: F.col(c).cast("double") for c in columns}
    n = df.agg(*[F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) for v in value.values()]).first()
    ranks = {c: [(k - 1) // 2, k // 2] for c, k in zip(columns, n, strict=True) if k}
    got = at_ranks(df, ranks, bins)
    return {c: (got[c, ranks[c][0]] + got[c, ranks[c][1]]) / 2 if c in ranks else None for c in columns}
