"""Multi-task ranking: a layer of experts, a softmax gate for each task over the experts it may use, a tower for each.

Which experts a task may use says which model it is: its own only (single-task), all (MMoE), shared and its own (CGC).
Rows stay where they are: in every step each part returns the sum of its gradients, Spark adds those vectors in two levels,
and the driver, which holds as many numbers as there are parameters, takes one step of Adam. ``Stacked`` puts several such layers
on each other (PLE), ``Selective`` lets each task take its share of one common layer through a sigmoid gate.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.vectors import vector_sum


#: Rows of one pass through a net: what it makes of them stays in a core's cache.
FEW = 1024


def single(tasks: int) -> np.ndarray:
    return np.eye(tasks, dtype=bool)


def mmoe(tasks: int, experts: int) -> np.ndarray:
    return np.ones((tasks, experts), bool)


def cgc(tasks: int, shared: int, own: int = 1) -> np.ndarray:
    """The first ``shared`` experts are everyone's, the others ``own`` for each task."""
    return np.concatenate([np.ones((tasks, shared), bool), np.repeat(single(tasks), own, 1)], 1)


class Net:
    """A model's weights as one vector, named by ``shapes``; what a model adds is ``forward`` and ``slopes``."""

    def __init__(self, shapes: dict[str, tuple[int, ...]], seed: int, flat: np.ndarray | None):
        self.shapes, self.size = shapes, sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.random.default_rng(seed).normal(0, 0.3, self.size) if flat is None else flat
        self.w = self.views(self.flat)

    def at(self, flat: np.ndarray) -> Net:
        """The same model with other weights."""
        other = copy.copy(self)
        other.flat, other.w = flat, self.views(flat)
        return other

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss of the rows and its gradient."""
        return self.slopes(x, y)[:2]

    def parameters(self) -> dict[str, int]:
        """Number of weights by kind: what comes before the first underscore of a name."""
        out: dict[str, int] = {}
        for name, shape in self.shapes.items():
            kind = name.partition("_")[0]
            out[kind] = out.get(kind, 0) + int(np.prod(shape))
        return out

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name], at = flat[at : at + n].reshape(shape), at + n
        return out


def _logistic(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def _loss(p: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over rows of the mean loss over tasks, and its slope in the logits; a missing label (NaN) adds nothing. A line
    for each task."""
    known = ~np.isnan(y)
    hit = np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)
    return -float(np.log(hit[known]).sum()) / len(y), np.where(known, p - np.nan_to_num(y), 0) / len(y)


def _softmax(a: np.ndarray) -> np.ndarray:
    """In place, over the second axis."""
    a -= a.max(1, keepdims=True)
    np.exp(a, a)
    a /= a.sum(1, keepdims=True)
    return a


class Mixture(Net):
    """One layer of experts: single-task, MMoE or CGC by ``allowed``."""

    def __init__(self, features: int, allowed: np.ndarray, width: int = 8, seed: int = 42, flat: np.ndarray | None = None):
        tasks, experts = allowed.shape
        self.allowed = allowed
        super().__init__({"expert": (features, experts, width), "offset": (experts, width), "gate": (features, tasks, experts), "tower": (tasks, width), "bias": (tasks,)}, seed, flat)

    def _up(self, xt: np.ndarray) -> tuple[np.ndarray, ...]:
        """Experts, gates, each expert seen through each task's tower, and probabilities; rows lie last, side by side."""
        tasks, experts = self.allowed.shape
        h = (self.w["expert"].reshape(len(xt), -1).T @ xt).reshape(experts, -1, xt.shape[1])
        h += self.w["offset"][:, :, None]
        np.maximum(h, 0, h)
        a = (self.w["gate"].reshape(len(xt), -1).T @ xt).reshape(tasks, experts, -1)
        a[~self.allowed] = -np.inf
        g, s = _softmax(a), np.matmul(self.w["tower"], h).transpose(1, 0, 2)
        return h, g, s, _logistic((g * s).sum(1) + self.w["bias"][:, None])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        *seen, p = self._up(np.ascontiguousarray(x.T))
        return *seen, p.T

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of the rows, its gradient in the weights and in ``x``."""
        xt = np.ascontiguousarray(x.T)
        h, g, s, p = self._up(xt)
        loss, d = _loss(p, y.T)
        flat = np.zeros(self.size)
        out = self.views(flat)
        c = g * d[:, None]  # a row's slope in each expert as each task's tower sees it
        da = c * (s - (g * s).sum(1, keepdims=True))
        taken = np.ascontiguousarray(c.transpose(1, 0, 2))
        out["bias"][:], out["tower"][:] = d.sum(1), np.matmul(taken, h.transpose(0, 2, 1)).sum(0)
        dh = np.matmul(self.w["tower"].T, taken)
        dh *= h > 0
        da, dh = da.reshape(-1, len(x)), dh.reshape(-1, len(x))
        out["gate"][:], out["expert"][:] = (xt @ da.T).reshape(out["gate"].shape), (xt @ dh.T).reshape(out["expert"].shape)
        out["offset"][:] = dh.sum(1).reshape(out["offset"].shape)
        return loss, flat, (self.w["gate"].reshape(len(xt), -1) @ da + self.w["expert"].reshape(len(xt), -1) @ dh).T


class Stacked(Net):
    """Levels of shared and own experts. A task's gate mixes its own and the shared ones, a gate of the shared line mixes
    all, and the mixtures are what the next level's experts and gates see; the last level has no shared line."""

    def __init__(self, features: int, tasks: int, shared: int = 1, own: int = 1, levels: int = 2, width: int = 8, seed: int = 42, flat: np.ndarray | None = None):
        self.tasks, self.levels = tasks, levels
        self.owner = np.r_[np.full(shared, tasks), np.repeat(np.arange(tasks), own)]
        self.allowed = np.concatenate([(self.owner == np.arange(tasks)[:, None]) | (self.owner == tasks), np.ones((1, len(self.owner)), bool)])
        n, shapes = len(self.owner), {}
        for k in range(levels):
            wide, lines = (width if k else features), tasks + (k + 1 < levels)
            shapes |= {f"expert_{k}": (n, wide, width), f"offset_{k}": (n, width), f"gate_{k}": (lines, wide, n)}
        super().__init__(shapes | {"tower": (tasks, width), "bias": (tasks,)}, seed, flat)

    def _up(self, xt: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """Each level's lines, experts and gates, and the last mixtures; rows lie last, side by side."""
        at, seen, many = [xt] * (self.tasks + 1), [], xt.shape[1]
        for k in range(self.levels):
            expert, gate = self.w[f"expert_{k}"], self.w[f"gate_{k}"]
            lines, n = len(gate), len(expert)
            if k:
                h, a = np.stack([w.T @ at[line] for line, w in zip(self.owner, expert, strict=True)]), np.stack([w.T @ at[line] for line, w in enumerate(gate)])
            else:  # all lines are the input
                h, a = (expert.transpose(0, 2, 1).reshape(-1, len(xt)) @ xt).reshape(n, -1, many), (gate.transpose(0, 2, 1).reshape(-1, len(xt)) @ xt).reshape(lines, n, many)
            h += self.w[f"offset_{k}"][:, :, None]
            np.maximum(h, 0, h)
            a[~self.allowed[:lines]] = -np.inf
            g = _softmax(a)
            seen.append((at, h, g))
            at = [sum(g[line, e] * h[e] for e in np.flatnonzero(self.allowed[line])) for line in range(lines)]
        return seen, np.stack(at)

    def _chance(self, mixed: np.ndarray) -> np.ndarray:
        return _logistic(np.matmul(self.w["tower"][:, None], mixed)[:, 0] + self.w["bias"][:, None])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        mixed = self._up(np.ascontiguousarray(x.T))[1]
        return mixed, self._chance(mixed).T

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of the rows, its gradient in the weights and in ``x``."""
        seen, mixed = self._up(np.ascontiguousarray(x.T))
        loss, d = _loss(self._chance(mixed), y.T)
        flat = np.zeros(self.size)
        out = self.views(flat)
        out["bias"][:], out["tower"][:] = d.sum(1), np.matmul(mixed, d[:, :, None])[:, :, 0]
        down = d[:, None] * self.w["tower"][:, :, None]
        for k in reversed(range(self.levels)):
            at, h, g = seen[k]
            expert, gate = self.w[f"expert_{k}"], self.w[f"gate_{k}"]
            da, dh = np.zeros_like(g), np.zeros_like(h)
            for line in range(len(gate)):
                for e in np.flatnonzero(self.allowed[line]):
                    da[line, e] = (down[line] * h[e]).sum(0)
                    dh[e] += g[line, e] * down[line]
            da -= (g * da).sum(1, keepdims=True)
            da *= g
            dh *= h > 0
            out[f"offset_{k}"][:] = dh.sum(2)
            if k:
                back = np.empty((len(gate), *at[0].shape))
                for line in range(len(gate)):
                    out[f"gate_{k}"][line], back[line] = at[line] @ da[line].T, gate[line] @ da[line]
                if len(gate) <= self.tasks:  # the shared line has no gate in the last level
                    back = np.concatenate([back, np.zeros((1, *at[0].shape))])
                for e, line in enumerate(self.owner):
                    out[f"expert_{k}"][e] = at[line] @ dh[e].T
                    back[line] += expert[e] @ dh[e]
                down = back
            else:
                xt, wide = at[0], len(at[0])
                da, dh = da.reshape(-1, len(x)), dh.reshape(-1, len(x))
                out["gate_0"][:] = (xt @ da.T).reshape(wide, *gate.shape[::2]).transpose(1, 0, 2)
                out["expert_0"][:] = (xt @ dh.T).reshape(wide, *expert.shape[::2]).transpose(1, 0, 2)
                down = (gate.transpose(1, 0, 2).reshape(wide, -1) @ da + expert.transpose(1, 0, 2).reshape(wide, -1) @ dh).T
        return loss, flat, down


class Selective(Net):
    """A layer common to all tasks, of which each takes a sigmoid-gated part beside a private layer of its own."""

    def __init__(self, features: int, tasks: int, common: int = 12, private: int = 4, seed: int = 42, flat: np.ndarray | None = None):
        self.common = common
        super().__init__({"expert_common": (features, common), "expert_private": (features, tasks, private), "gate": (features, tasks, common), "tower": (tasks, common + private), "bias": (tasks,)}, seed, flat)

    def _up(self, xt: np.ndarray) -> tuple[np.ndarray, ...]:
        """The common layer, private ones, gates, gated common ones and probabilities; rows lie last, side by side."""
        tasks, wide, tower = len(self.w["bias"]), len(xt), self.w["tower"][:, None]
        s, own = self.w["expert_common"].T @ xt, (self.w["expert_private"].reshape(wide, -1).T @ xt).reshape(tasks, -1, xt.shape[1])
        np.maximum(s, 0, s), np.maximum(own, 0, own)
        g = _logistic(self.w["gate"].reshape(wide, -1).T @ xt).reshape(tasks, self.common, -1)
        part = g * s
        return s, own, g, part, _logistic((np.matmul(tower[:, :, : self.common], part) + np.matmul(tower[:, :, self.common :], own))[:, 0] + self.w["bias"][:, None])

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        *seen, p = self._up(np.ascontiguousarray(x.T))
        return *seen, p.T

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of the rows, its gradient in the weights and in ``x``."""
        xt = np.ascontiguousarray(x.T)
        s, own, g, part, p = self._up(xt)
        loss, d = _loss(p, y.T)
        flat, wide, many = np.zeros(self.size), len(xt), len(x)
        out = self.views(flat)
        out["bias"][:], out["tower"][:] = d.sum(1), np.concatenate([np.matmul(z, d[:, :, None])[:, :, 0] for z in (part, own)], 1)
        taken = d[:, None] * self.w["tower"][:, : self.common, None]
        ds = (taken * g).sum(0) * (s > 0)
        dp = d[:, None] * self.w["tower"][:, self.common :, None] * (own > 0)
        taken *= part
        taken *= 1 - g
        da, dp = taken.reshape(-1, many), dp.reshape(-1, many)
        out["gate"][:], out["expert_private"][:] = (xt @ da.T).reshape(out["gate"].shape), (xt @ dp.T).reshape(out["expert_private"].shape)
        out["expert_common"][:] = xt @ ds.T
        return loss, flat, (self.w["expert_common"] @ ds + self.w["gate"].reshape(wide, -1) @ da + self.w["expert_private"].reshape(wide, -1) @ dp).T


def comparable(nets: dict[str, Net], reference: str, within: float = 0.2) -> dict[str, bool]:
    """Which models have as many weights as the reference, give or take the share ``within``."""
    size = nets[reference].size
    return {name: abs(net.size - size) <= within * size for name, net in nets.items()}


def _columns(batch: pa.RecordBatch, start: int, end: int, kind: type) -> np.ndarray:
    """A row for each row of the batch; columns lie side by side in memory, as the nets want them."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(kind, copy=False) for i in range(start, end)]).T


def _plain(columns: list[str], missing: float, name: str, kind: str) -> list:
    return [F.coalesce(F.col(c).cast(kind), F.lit(missing).cast(kind)).alias(f"{name}{i}") for i, c in enumerate(columns)]


def adam(net: Net, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int, rate: float) -> tuple[Net, np.ndarray, np.ndarray]:
    """The net after step ``t`` (from 1) of Adam, and the means of slopes and squared slopes."""
    m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
    return net.at(net.flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)), m, v


def descend(packed: DataFrame, net: Net, gradient: Callable[[Net, pa.RecordBatch], tuple[float, np.ndarray]], steps: int, rate: float) -> tuple[Net, list[float]]:
    """The net after ``steps`` of Adam over all rows of ``packed``, and its mean loss before each of them.

    Every part sums its gradient, Spark adds those vectors; what comes to the driver is as long as ``net.flat``.
    """
    packed, parts = packed.persist(), packed.rdd.getNumPartitions()
    m, v, losses, size = np.zeros(net.size), np.zeros(net.size), [], net.size
    for t in range(1, steps + 1):

        def scan(batches, here=net):
            n, loss, total = 0, 0.0, np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    one, g = gradient(here, batch)
                    n, loss, total = n + batch.num_rows, loss + one, total + g
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n, loss], total])], pa.list_(pa.float64()))], names=["v"])

        got = vector_sum(packed.mapInArrow(scan, "v array<double>"), parts)
        if got is None:
            break
        losses.append(got[1] / got[0])
        net, m, v = adam(net, got[2:] / got[0], m, v, t, rate)
    packed.unpersist()
    return net, losses


def fit(rows: DataFrame, features: list[str], labels: list[str], model: np.ndarray | Net, steps: int = 20, rate: float = 0.1, width: int = 8, seed: int = 42) -> tuple[Net, list[float]]:
    """A trained model and its mean loss before each step; ``model`` is a start, or which experts a task of one layer may use.

    Null features are 0, null labels unknown; without rows the start stays. A pass of FEW rows is in single precision, what
    passes add up to is in double.
    """
    net = model if isinstance(model, Net) else Mixture(len(features), model, width, seed)
    # plain columns pass to Python much faster than arrays do
    packed = rows.select(*_plain(features, 0.0, "_x", "float"), *_plain(labels, float("nan"), "_y", "float"))
    nx, ny = len(features), len(labels)

    def gradient(here: Net, batch: pa.RecordBatch) -> tuple[float, np.ndarray]:
        x, y, single = _columns(batch, 0, nx, np.float32), _columns(batch, nx, nx + ny, np.float32), here.at(here.flat.astype(np.float32))
        parts = [single.slopes(x[i : i + FEW], y[i : i + FEW]) for i in range(0, len(x), FEW)]
        return sum(float(part[0]) for part in parts), sum(part[1] for part in parts)

    return descend(packed, net, gradient, steps, rate)


def predict(rows: DataFrame, net: Net, features: list[str], tasks: list[str], carry: list[str]) -> DataFrame:
    """(carry..., task, p): each task's probability for every row."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)

    def scan(batches):
        for batch in batches:
            p = net.forward(_columns(batch, len(carry), len(carry) + len(features), np.float64))[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(list(p), pa.list_(pa.float64()))], names=[*carry, "p"])

    scored = rows.select(*carry, *_plain(features, 0.0, "_x", "double")).mapInArrow(scan, f"{fields}, p array<double>")
    named = F.arrays_zip(F.array(*map(F.lit, tasks)).alias("task"), F.col("p"))
    return scored.select(*carry, F.explode(named).alias("_t")).select(*carry, F.col("_t.task").alias("task"), F.col("_t.p").alias("p"))
