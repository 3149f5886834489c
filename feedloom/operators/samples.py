"""Training samples: left joins that keep every row once, cold defaults, and scaling by the training split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(samples: DataFrame, parts: list[tuple[DataFrame, list[str], dict[str, Column]]]) -> DataFrame:
    """``samples`` with the columns of each part ``(features, keys, cold)`` joined on its keys.

    A key that a part repeats counts once, so no sample is doubled; a sample without features, or with a null key, gets
    the value of ``cold`` for each of them. Only the keys and the columns in ``cold`` are read from a part.
    """
    out = samples
    for features, keys, cold in parts:
        once = features.select(*keys, *cold).dropDuplicates(keys)
        out = out.join(once, keys, "left").withColumns({c: F.coalesce(F.col(c), value) for c, value in cold.items()})
    return out


def standardised(rows: DataFrame, train: Column, columns: dict[str, Column], places: int | None = None) -> DataFrame:
    """``rows`` with each column of ``columns`` set to its expression's distance from the training mean in deviations.

    The deviation is that of the population of rows for which ``train`` holds; a column that is constant there, or has
    no training row, becomes 0. One pass makes one row of numbers, and the rest is expressions.
    """
    of = {c: F.when(train, v) for c, v in columns.items()}
    stats = rows.agg(*[F.avg(v).alias(f"_m_{c}") for c, v in of.items()], *[F.stddev_pop(v).alias(f"_d_{c}") for c, v in of.items()])
    z = {c: F.when(F.col(f"_d_{c}") > 1e-12, (v - F.col(f"_m_{c}")) / F.col(f"_d_{c}")).otherwise(0.0) for c, v in columns.items()}
    out = rows.crossJoin(F.broadcast(stats)).withColumns({c: F.round(v, places) if places is not None else v for c, v in z.items()})
    return out.drop(*[f"_m_{c}" for c in columns], *[f"_d_{c}" for c in columns])
