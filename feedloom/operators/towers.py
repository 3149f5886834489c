"""Two towers for retrieval: a user vector and an item vector of unit length whose product ranks the items.

The user tower sees dense features and the mean embedding of the history, the item tower the item's embedding and, if
given, side features; both are two dense layers, the last without activation. Training compares the target with the
negatives listed in its row, so neither the order of rows nor their parts matter. Weights are as many as the hashed
embedding rows and the layers ask for, whatever the number of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.multitask import Net, descend


def _unit(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((z * z).sum(-1, keepdims=True)) + 1e-9
    return z / n, n


def _members(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all histories end to end, padding left out: the row, the embedding row and its share in the row's mean."""
    flat = np.concatenate([np.zeros(0, np.int64), *history]).astype(np.int64)
    whose = np.repeat(np.arange(len(history)), [len(h) for h in history])[flat > 0]
    return whose, flat[flat > 0], 1 / np.bincount(whose, minlength=len(history))[whose]


def _rows_summed(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` by the row that each belongs to."""
    return np.stack([np.bincount(at, values[:, c], rows) for c in range(values.shape[1])], 1)


class Towers(Net):
    """Weights of both towers over ``rows`` embedding rows; row 0 is padding and unknown items share what they hash to."""

    def __init__(self, dense: int, side: int = 0, rows: int = 256, width: int = 8, hidden: int = 16, out: int = 8, temperature: float = 0.2, seed: int = 42, flat: np.ndarray | None = None):
        self.dense, self.side, self.rows, self.temperature = dense, side, rows, temperature
        super().__init__({"embedding": (rows, width), "user_in": (dense + width, hidden), "user_out": (hidden, out), "item_in": (width + side, hidden), "item_out": (hidden, out)}, seed, flat)

    def _tower(self, name: str, x: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.maximum(x @ self.w[f"{name}_in"], 0)
        vector, norm = _unit(h @ self.w[f"{name}_out"])
        return x, h, vector, norm

    def users(self, dense: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Passes of the user tower; a history's padding counts for nothing, an empty one is the zero vector."""
        whose, real, share = _members(history)
        pooled = _rows_summed(whose, self.w["embedding"][real] * share[:, None], len(history))
        return self._tower("user", np.concatenate([dense, pooled], 1))

    def items(self, ids: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
        return self._tower("item", np.concatenate([self.w["embedding"][ids], side], -1))

    def _back(self, name: str, passes: tuple[np.ndarray, ...], d: np.ndarray, out: dict[str, np.ndarray]) -> np.ndarray:
        x, h, vector, norm = passes
        dz = (d - vector * (d * vector).sum(-1, keepdims=True)) / norm
        flat = lambda a: a.reshape(-1, a.shape[-1])
        out[f"{name}_out"] += flat(h).T @ flat(dz)
        dh = dz @ self.w[f"{name}_out"].T * (h > 0)
        out[f"{name}_in"] += flat(x).T @ flat(dh)
        return dh @ self.w[f"{name}_in"].T

    def gradient(self, dense: np.ndarray, history: list[np.ndarray], ids: np.ndarray, side: np.ndarray, log_q: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the rows' losses and its gradient; a row's first candidate is its target, ``log_q`` is taken off the scores.

        A negative that hashes to the target's row and has its side features can't be told from it and is left out.
        """
        user, item = self.users(dense, history), self.items(ids, side)
        score = np.einsum("bo,bco->bc", user[2], item[2]) / self.temperature - log_q
        same = (ids == ids[:, :1]) & (side == side[:, :1]).all(2)
        same[:, 0] = False
        score = np.where(same, -np.inf, score)
        top = score.max(1, keepdims=True)
        p = np.exp(score - top)
        total = p.sum(1, keepdims=True)
        loss = float((np.log(total[:, 0]) + top[:, 0] - score[:, 0]).sum())
        d = p / total
        d[:, 0] -= 1
        d /= self.temperature
        flat = np.zeros(self.size)
        out = self.views(flat)
        dx = self._back("user", user, np.einsum("bc,bco->bo", d, item[2]), out)[:, self.dense :]
        whose, real, share = _members(history)
        out["embedding"] += _rows_summed(real, dx[whose] * share[:, None], self.rows)
        de = self._back("item", item, d[:, :, None] * user[2][:, None, :], out)[..., : out["embedding"].shape[1]]
        out["embedding"] += _rows_summed(ids.ravel(), de.reshape(-1, de.shape[-1]), self.rows)
        return loss, flat


def hashed(item: Column, rows: int) -> Column:
    """The embedding row of an item, from 1; null is the padding 0."""
    return F.when(item.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(item.cast("string")), F.lit(rows - 1)) + 1).cast("int")


def _dense(columns: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]) if columns else F.array().cast("array<double>")


def _floats(col: pa.Array, *shape: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), *shape)


def _lists(col: pa.Array) -> list[np.ndarray]:
    flat, ends = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(col) else []


def fit(rows: DataFrame, negatives: DataFrame, items: DataFrame, net: Towers, features: list[str], side: list[str], key: str = "row_id", item: str = "video_id", steps: int = 20, rate: float = 0.05) -> tuple[Towers, list[float]]:
    """Trained towers and the mean loss before each step.

    ``rows(key, item, hist, features...)`` with arrays of items as history, ``negatives(key, slot, negative)`` with the
    same number for each row, ``items(item, log_q, side...)`` one row an item. Rows whose target, or one of whose negatives,
    is not in ``items`` are not learnt from. Null features and histories are zero and empty.
    """
    n = net.rows
    table = items.select(F.col(item).alias("_c"), F.coalesce("log_q", F.lit(0.0)).cast("double").alias("q"), _dense(side).alias("side"))
    asked = rows.select(key, F.lit(-1).alias("slot"), F.col(item).alias("_c")).unionByName(negatives.select(key, "slot", F.col("negative").alias("_c")))
    known = asked.join(table, "_c", "left")
    listed = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", hashed(F.col("_c"), n).alias("row"), "q", "side"))).alias("c"), F.bool_and(F.col("q").isNotNull()).alias("whole"))
    history = F.transform(F.coalesce("hist", F.array().cast(rows.schema["hist"].dataType)), lambda x: hashed(x, n))
    joined = rows.select(key, _dense(features).alias("x"), history.alias("h")).join(listed.where("whole"), key)
    packed = joined.select("x", "h", F.col("c.row").alias("ids"), F.flatten("c.side").alias("side"), F.col("c.q").alias("q"))

    def gradient(here: Towers, batch: pa.RecordBatch) -> tuple[float, np.ndarray]:
        ids = np.stack(_lists(batch.column("ids")))
        return here.gradient(_floats(batch.column("x"), here.dense), _lists(batch.column("h")), ids, _floats(batch.column("side"), ids.shape[1], here.side), _floats(batch.column("q"), ids.shape[1]))

    return descend(packed, net, gradient, steps, rate)


def user_vectors(rows: DataFrame, net: Towers, features: list[str], key: str = "row_id") -> DataFrame:
    """(query_id, q): the user tower's vector of every row of ``rows(key, hist, features...)``."""
    kind, n = rows.schema[key].dataType.simpleString(), net.rows

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                v = net.users(_floats(batch.column("x"), net.dense), _lists(batch.column("h")))[2]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["query_id", "q"])

    history = F.transform(F.coalesce("hist", F.array().cast(rows.schema["hist"].dataType)), lambda x: hashed(x, n))
    return rows.select(key, _dense(features).alias("x"), history.alias("h")).mapInArrow(scan, f"query_id {kind}, q array<double>")


def item_vectors(items: DataFrame, net: Towers, side: list[str], item: str = "video_id", carry: list[str] | None = None) -> DataFrame:
    """(item_id, carry..., v): the item tower's vector of every row of ``items(item, carry..., side...)``."""
    carry = carry or []
    kind, n = items.schema[item].dataType.simpleString(), net.rows
    fields = ", ".join([f"item_id {kind}", *[f"`{c}` {items.schema[c].dataType.simpleString()}" for c in carry]])

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                v = net.items(batch.column("row").to_numpy(zero_copy_only=False), _floats(batch.column("side"), net.side))[2]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(c) for c in carry), pa.array(list(v), pa.list_(pa.float64()))], names=["item_id", *carry, "v"])

    return items.select(F.col(item).alias("item_id"), *carry, hashed(F.col(item), n).alias("row"), _dense(side).alias("side")).mapInArrow(scan, f"{fields}, v array<double>")


def as_of(items: DataFrame, days: DataFrame, day: str, dated: dict[str, Column]) -> DataFrame:
    """``items`` once for each row of ``days(day)``, the distinct days of the requests, with ``dated`` columns as of then.

    A calendar is short, and the days come to each item as one array, so items are not joined with them row by row.
    """
    listed = days.select(day).distinct().agg(F.sort_array(F.collect_list(day)).alias("_days"))
    return items.crossJoin(F.broadcast(listed)).withColumn(day, F.explode("_days")).drop("_days").withColumns(dated)  # one row: a calendar
