"""Plumbing shared by the training-data operators: worker imports, shared folder, ordered exchange, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Rows in an Arrow batch sent to Python, unless the session sets its own: texts can be long, so batches stay short.
ARROW_ROWS = "1000"
#: Workers keep freed memory up to this size: numpy's temporaries would otherwise be mapped anew each time. Arrow uses the
#: same allocator, so that what it frees is not kept in a pool of its own.
_ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(48 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches of long texts small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in _ALLOCATOR.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def release() -> None:
    """Give a worker's freed memory back to the machine, at the end of a task: workers stay between tasks and stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own checkpoint folder.

    Where neither is set, a local session gets a temporary one; on a cluster that would be one machine's, so it raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared one."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _count_at_most(bounds: list, key: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)


def _region(cuts: list, k: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``k``, in two levels: about twice the square root of their number."""
    width = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not fine:
        return F.lit(0)
    at = F.greatest(_count_at_most([x[0] for x in fine], k), F.lit(1)) - 1
    inner = F.array(*[F.array(*map(F.lit, x)) for x in fine])
    return (at * width + F.size(F.filter(F.element_at(inner, (at + 1).cast("int")), lambda b: b <= k))).cast("int")


def _order_value(df: DataFrame, key: str) -> Column:
    """A number that ascends with ``key``: itself, or of a string the seven bytes after what all strings begin with."""
    kind = df.schema[key].dataType
    if isinstance(kind, NumericType):
        return F.col(key)
    if not isinstance(kind, StringType):
        return F.col(key).cast("timestamp").cast("double")
    low, high = df.agg(F.min(key), F.max(key)).first()
    same = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    tail = F.substring(F.rpad(F.hex(F.col(key).cast("binary")), 2 * same + 14, "0"), 2 * same + 1, 14)
    return F.conv(tail, 16, 10).cast("long")


def range_ids(df: DataFrame, key: str, n: int, tie: Column | None = None) -> tuple[DataFrame, list[tuple[int, object]]]:
    """Add ``_part``: contiguous ranges of ``key`` in ascending order, nulls in the first, about equal in rows.

    Only the key column is read to find the ``n - 1`` bounds. The second value lists (part, smallest key) of the
    parts that have rows. ``key`` may be numbers, strings or times. Rows that tie on the key share a part unless
    ``tie`` is given, a long that is spread over its whole range: then a key that holds several parts' share of the
    rows, or null, gets as many parts as its share, in ascending order of ``tie``.
    """
    value = _order_value(df, key)
    cuts, nulls, rows = df.select(value.alias("v")).agg(F.percentile_approx("v", [i / n for i in range(1, n)], 50 * n) if n > 1 else F.lit(None), F.count_if(F.col("v").isNull()), F.count("*")).first()
    cuts = sorted(cuts or [])
    bounds = sorted(set(cuts))
    region = _region(bounds, value)
    if tie is None:
        part = region
        none = F.lit(0)
    else:
        share = (tie.cast("double") / F.lit(2.0**64) + 0.5).cast("double")
        most = max(1, -(-nulls * n // rows)) if rows else 1
        times = [1] + [cuts.count(b) for b in bounds]
        sizes = [m + 1 if m > 1 else 1 for m in times]  # parts of a bound that repeats, then one of what is above it
        first = [(most if nulls else 0) + sum(sizes[:i]) for i in range(len(sizes))]
        at = region + 1
        many = F.element_at(F.array(*map(F.lit, times)), at)
        equal = value == F.element_at(F.array(*map(F.lit, [None, *bounds])), at) if bounds else F.lit(False)
        within = F.when(many > 1, F.when(equal, F.least(F.floor(share * many), many - 1)).otherwise(many)).otherwise(0)
        part = F.element_at(F.array(*map(F.lit, first)), at) + within
        none = F.least(F.floor(share * most), F.lit(most - 1))
    out = df.withColumn("_part", F.when(F.col(key).isNotNull(), part).otherwise(none).cast("int"))
    firsts = [(r[0], r[1]) for r in out.groupBy("_part").agg(F.min(key)).orderBy("_part").collect()]
    return out, firsts


def exchange_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls, without a copy."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - (off[0] if len(off) else 0)


def doc_chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
