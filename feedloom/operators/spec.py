"""A feature encoder fitted as one row of statistics and applied as expressions, the same for known rows and cold ones."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.encoding import category_map
from feedloom.operators.guards import drop_constants
from feedloom.operators.selection import medians

#: Kinds whose values are damped by log1p and brought to mean 0 and deviation 1.
SCALED = ("count", "numeric")


@dataclass
class Spec:
    """What ``fit`` found: a number or three for each column, category maps as tables, and the constants dropped."""

    kinds: dict[str, str]
    numbers: dict[str, float]
    categories: dict[str, DataFrame] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)


def fit(rows: DataFrame, kinds: dict[str, str], priors: dict[str, float] | None = None, samples: DataFrame | None = None) -> Spec:
    """``kinds`` names the class of each column:

    - ``count``: null is 0; log1p, standardised by all rows, filled ones included;
    - ``numeric``: null is the exact median; log1p, standardised by the rows that are known, filled ones not included;
    - ``smooth``: null is the column's prior in ``priors``, nothing else is done; ``zero``: null is 0;
    - ``category``: 1 to n in the order of the values, unknown and null 0; of one value, null being a value, it is dropped.

    Counts are standardised by ``samples`` if given: training rows with the features joined, in which what a row has no
    feature for is null; so they weigh by how often training sees them and cold rows count as 0. Deviations are those of
    a sample; of a column that has nearly none, or one known value, it counts as 1.
    """
    categories = [c for c, k in kinds.items() if k == "category"]
    dropped = drop_constants(rows.select(*categories))[1] if categories else []
    live = {c: k for c, k in kinds.items() if c not in dropped}
    fills = {c: 0.0 for c, k in live.items() if k in ("count", "zero")} | {c: float((priors or {})[c]) for c, k in live.items() if k == "smooth"}
    fills |= {c: float(m or 0.0) for c, m in medians(rows, [c for c, k in live.items() if k == "numeric"]).items()}
    numbers = {f"{c}_fill": v for c, v in fills.items()}
    for source, kind in ((rows if samples is None else samples, "count"), (rows, "numeric")):
        value = {c: F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if kind == "count" else F.col(c).cast("double")) for c, k in live.items() if k == kind}
        if value:
            got = source.agg(*[f(v).alias(f"{c}_{name}") for c, v in value.items() for name, f in (("mean", F.avg), ("std", F.stddev_samp))]).first()
            for c in value:
                dev = got[f"{c}_std"] or 0.0
                numbers |= {f"{c}_mean": got[f"{c}_mean"] or 0.0, f"{c}_std": dev if dev > 1e-12 else 1.0}
    return Spec(live, numbers, {c: category_map(rows, c) for c in categories if c not in dropped}, dropped)


def expression(spec: Spec, c: str) -> Column:
    """The encoded value of a column that is no category: filled first, then damped, then standardised."""
    filled = F.coalesce(F.col(c).cast("double"), F.lit(spec.numbers[f"{c}_fill"]))
    return (F.log1p(filled) - spec.numbers[f"{c}_mean"]) / spec.numbers[f"{c}_std"] if spec.kinds[c] in SCALED else filled


def apply(rows: DataFrame, spec: Spec, *keys: str) -> DataFrame:
    """(keys, encoded columns) of every row; a column that is all null gives the cold values. Columns that ``rows`` lacks
    are skipped."""
    there = [c for c in spec.kinds if c in rows.columns]
    out = rows.select(*keys, *there)
    for c, table in spec.categories.items():
        if c in there:
            out = out.join(table.select(F.col("value").alias(c), F.col("code").alias(f"{c}__code")), c, "left")
    return out.select(*keys, *[(F.coalesce(f"{c}__code", F.lit(0)) if spec.kinds[c] == "category" else expression(spec, c)).alias(c) for c in there])


def with_cold_row(rows: DataFrame, key: str, cold: int = 0) -> DataFrame:
    """``rows`` and one more of key ``cold`` in which all else is null: through ``apply`` it becomes the cold row."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    one = rows.sparkSession.range(1).select(*[F.lit(cold if c == key else None).cast(k).alias(c) for c, k in kinds.items()])
    return rows.unionByName(one)
