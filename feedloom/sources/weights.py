"""Trained weights as a table: a row for each run of a named array, with a digest, so that parts can be read alone.

(name, shape, position, values, digest): ``values`` are up to RUN numbers of the flattened array from ``position`` on, and
``digest`` is the sha256 of their 64-bit little-endian bytes. Equal digests mean equal bits: NaN and -0.0 count as they
are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers in a row.
RUN = 4096
SCHEMA = "name string, shape array<long>, position long, values array<double>, digest string"


def digest(values: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(values, "<f8").tobytes()).hexdigest()


def as_table(spark: SparkSession, arrays: dict[str, np.ndarray], run: int = RUN) -> DataFrame:
    """The table of driver-side ``arrays`` (a model's dense layers); an empty array is one row without values."""
    rows = []
    for name, x in arrays.items():
        flat = np.asarray(x, np.float64).ravel()
        for at in range(0, max(1, len(flat)), run):
            part = flat[at : at + run]
            rows.append((name, list(np.shape(x)), at, part.tolist(), digest(part)))
    return spark.createDataFrame(rows, SCHEMA)


def embedding_rows(table: DataFrame, name: str, key: str, vector: str) -> DataFrame:
    """The same layout for a distributed table of vectors: an id's vector is one row, its id the position. Nothing of it
    comes to the driver."""

    def scan(batches):
        for batch in batches:
            made = [digest(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["position", "values", "digest"])

    rows = table.select(F.col(key).cast("long").alias("position"), F.col(vector).cast("array<double>").alias("values")).mapInArrow(scan, "position long, values array<double>, digest string")
    return rows.select(F.lit(name).alias("name"), F.array(F.size("values").cast("long")).alias("shape"), "position", "values", "digest")


def save(table: DataFrame, path: str) -> None:
    """Write a weights table, dealt by name so that one array is read from its own files; an existing path is an error."""
    table.write.partitionBy("name").parquet(path)


def load(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The weights saved at ``path``, of ``names`` only if given: other arrays' files are not read."""
    got = spark.read.schema(SCHEMA).parquet(path)
    return got.where(F.col("name").isin(names)) if names is not None else got


def to_arrays(table: DataFrame) -> dict[str, np.ndarray]:
    """The arrays of a table of dense layers, on the driver; a missing or damaged run is an error."""
    out: dict[str, list] = {}
    for r in table.collect():
        if digest(np.array(r["values"])) != r["digest"]:
            raise ValueError(f"{r['name']} at {r['position']}: the values are not those of the digest")
        out.setdefault(r["name"], []).append(r)
    arrays = {}
    for name, rows in out.items():
        rows.sort(key=lambda r: r["position"])
        flat = np.concatenate([np.array(r["values"]) for r in rows])
        if [r["position"] for r in rows] != np.r_[0, np.cumsum([len(r["values"]) for r in rows])[:-1]].tolist() or len(flat) != int(np.prod(rows[0]["shape"])):
            raise ValueError(f"{name}: runs are missing or repeated")
        arrays[name] = flat.reshape([int(x) for x in rows[0]["shape"]])
    return arrays


def differences(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(side, name, position) of runs that only one of two tables has, bit for bit; no rows if the tables are identical."""
    columns = columns or ["name", "shape", "position", "digest"]
    one, two = a.select(*columns), b.select(*columns)
    return one.exceptAll(two).select(F.lit("first").alias("side"), "name", "position").unionByName(two.exceptAll(one).select(F.lit("second").alias("side"), "name", "position"))


def proven_equal(train: Callable[[], DataFrame], again: Callable[[], DataFrame]) -> DataFrame:
    """``differences`` of what two runs give: the proof that a change altered no bit."""
    return differences(train(), again())
