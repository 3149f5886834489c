"""Sums of long vectors, a row for each part, without exploding them into numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _add(batches):
    total = None
    for batch in batches:
        for row in batch.column("v"):
            x = row.values.to_numpy(zero_copy_only=False)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])


def vector_sum(vectors: DataFrame, parts: int) -> np.ndarray | None:
    """The sum of ``vectors(v array<double>)`` of equal length, of which there are about ``parts``; None without rows.

    Two levels: about sqrt(parts) tasks add up as many vectors each, one task adds up those sums, and one vector comes to
    the driver. Every task holds two vectors at a time. Sums are in double precision, in the order rows come.
    """
    groups = max(1, math.isqrt(max(1, parts)))
    dealt = vectors.select("v", F.spark_partition_id().alias("_p"))
    if groups > 1:
        dealt = dealt.repartition(groups, F.pmod("_p", F.lit(groups))).select("v").mapInArrow(_add, "v array<double>")
    rows = dealt.select("v").repartition(1).mapInArrow(_add, "v array<double>").collect()
    return np.array(rows[0][0]) if rows else None
