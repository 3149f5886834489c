"""The first rows of an ordered dataset, from the files that can hold them."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _bounds(path: str, column: str) -> tuple[int, object, object, int]:
    """(rows, least, greatest, nulls) of a column from a file's footer; least is None if the footer doesn't say."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)
    with fs.open_input_file(at) as f:
        meta = pq.ParquetFile(f).metadata
    k = [i for i in range(meta.num_columns) if meta.schema.column(i).path == column]
    low = high = None
    nulls = 0
    for g in range(meta.num_row_groups):
        s = meta.row_group(g).column(k[0]).statistics if k else None
        if s is None or s.null_count is None or (not s.has_min_max and s.null_count < meta.row_group(g).num_rows):
            return meta.num_rows, None, None, 0
        nulls += s.null_count
        if s.has_min_max:
            low, high = s.min if low is None else min(low, s.min), s.max if high is None else max(high, s.max)
    return meta.num_rows, low, high, nulls


def footers(spark: SparkSession, path: str, column: str) -> list[tuple[str, int, object, object, int, bool]]:
    """(path, rows, least, greatest, nulls, said) of each Parquet file below ``path``, footers read by tasks, no data.

    Whole numbers only; ``said`` is False where a footer has no bounds, as for other kinds of columns.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    n = max(1, min(64, spark.sparkContext.defaultParallelism * 4))

    def scan(batches):
        for batch in batches:
            made = [(p, *_bounds(p, column)) for p in batch.column(0).to_pylist()]
            whole = [isinstance(low, int) and isinstance(high, int) or (low is None and nulls == rows) for _, rows, low, high, nulls in made]
            ints = lambda k: pa.array([r[k] if isinstance(r[k], int) else None for r in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ints(1), ints(2), ints(3), ints(4), pa.array(whole, pa.bool_())], names=["path", "rows", "low", "high", "nulls", "said"])

    got = files.repartition(n).mapInArrow(scan, "path string, rows long, low long, high long, nulls long, said boolean").collect()
    return sorted(tuple(r) for r in got)


def files_of_head(bounds: list[tuple[str, int, object, object, int, bool]], n: int) -> list[str]:
    """Files that can hold one of the first ``n`` rows in ascending order, nulls first.

    The n-th row is at most the least bound B for which the files that lie up to B have n rows; a file that begins beyond
    B can't hold any of them. Files with nulls, or whose footer says nothing, always stay.
    """
    total, bound = 0, None
    for _, rows, _, high, _, said in sorted((b for b in bounds if b[5]), key=lambda b: (b[3] is not None, b[3] or 0)):
        total += rows
        if total >= n:
            bound = high
            break
    else:
        return [b[0] for b in bounds]
    return [p for p, _, low, _, nulls, said in bounds if not said or nulls or (low is not None and bound is not None and low <= bound)]


def first_n(spark: SparkSession, path: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of the Parquet files at ``path`` in ascending ``order``, nulls first; all if there are fewer.

    Only files that can hold them are read, by the bounds of the first column. Ties beyond ``order`` come in any order.
    """
    if n < 0:
        raise ValueError("n is at least 0")
    kept = files_of_head(footers(spark, path, order[0]), n) if n else []
    if not kept:
        return spark.read.parquet(path).limit(0)
    return spark.read.parquet(*kept).orderBy(*order).limit(n)
