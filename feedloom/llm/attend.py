"""Causal self-attention whose values are distributions of the next row, so that no softmax over outputs is needed.

*Model.* The probability of the next row y after a position is a mean of ``value[x_j, y]`` over the position and the ones
before it in its window, weighted by a softmax of query times key plus a bias for the distance. Queries and keys are
learnt vectors of the rows. A sink, whose logit depends on the position's own row, adds the rows' overall shares.

*Values.* They are counted: how often y follows x directly, after one other, or at any greater distance that a window
reaches; counts are discounted, what is taken off goes to y's overall share. In training a pair's own occurrence is left
out of its value, or the weights would trust rare pairs that the training text has made itself.
"""

from __future__ import annotations

import numpy as np

#: What is taken off each count of a pair; tables of values: next, next but one, farther.
DISCOUNT, TABLES = 0.75, 3
#: Windows at once: their arrays stay in a core's cache.
BATCH = 192
_MOST = 60.0  # exponentials are taken of at most this, and at least its negative


class Shape:
    """Sizes of a model over ``rows`` rows, in blocks of ``step`` positions that see the block before."""

    def __init__(self, rows: int, step: int, key: int):
        self.rows, self.step, self.key = rows, step, key
        self.width = 2 * key + 1
        self.parameters = rows * self.width + 2 * step
        self.distance = np.maximum(np.arange(step)[:, None] + step - np.arange(2 * step)[None], 0)
        self.causal = (np.arange(step)[:, None] + step >= np.arange(2 * step)[None]).astype(np.float32)

    def unpack(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, key and sink of each row; bias of each distance), as views."""
        at = self.rows * self.width
        return flat[:at].reshape(self.rows, self.width), flat[at:]

    def start(self, seed: int = 3) -> np.ndarray:
        """Weights that trust the nearest rows most, with small random queries and keys."""
        flat = np.random.default_rng(seed).normal(0, 0.3, self.parameters).astype(np.float32)
        each, place = self.unpack(flat)
        each[:, -1] = -2
        place[:] = -3.3 - 0.08 * np.arange(2 * self.step)
        place[:2] = 0.5, -1.5
        return flat


class Pairs:
    """Counts of the pairs that windows hold: y right after x, after one more, or farther behind."""

    def __init__(self, rows: int, step: int, at_once: int = 3_000_000):
        self.rows, self.step, self.n = rows, step, 0
        self.wide = rows + 1  # a row more for what is outside of a text
        self.sums = np.zeros((TABLES, self.wide**2), np.int64)
        self.cells = np.empty(at_once, np.int64)  # cells of far pairs that wait to be counted

    def add(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, real: np.ndarray) -> None:
        """Count the pairs of consecutive blocks, the first one a first."""
        step, most = self.step, len(self.cells) // (2 * self.step**2)
        y = np.where(real, y, self.rows)
        both = np.empty((len(x), 2 * step), np.int64)
        both[:, step:] = x
        both[1:, :step] = x[:-1]
        both[first, :step] = self.rows
        both *= self.wide
        for d in (0, 1):
            self.sums[d] += np.bincount((both[:, step - d : 2 * step - d] + y).ravel(), minlength=self.wide**2)
        for i in range(0, len(x), most):
            b, t = both[i : i + most], y[i : i + most]
            for k in range(step):
                size = len(b) * (k + step - 1)
                if self.n + size > len(self.cells):
                    self._far()
                np.add(b[:, : k + step - 1], t[:, k : k + 1], out=self.cells[self.n : self.n + size].reshape(len(b), -1))
                self.n += size

    def _far(self) -> None:
        self.sums[2] += np.bincount(self.cells[: self.n], minlength=self.wide**2)
        self.n = 0

    def counts(self) -> np.ndarray:
        """(TABLES, rows, rows) of all that was added."""
        self._far()
        return np.ascontiguousarray(self.sums.reshape(TABLES, self.wide, self.wide)[:, : self.rows, : self.rows])


def values(counts: np.ndarray, left_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(overall share of each row, next-row distributions of each table), each pair without ``left_out`` of its occurrences."""
    rows = counts.shape[1]
    share = counts[0].sum(0) + 0.5
    share /= share.sum()
    out = np.empty(counts.shape, np.float32)
    for t, seen in zip(out, counts, strict=True):
        kinds = (seen > 0).sum(1, keepdims=True) - ((seen > 0) & (seen <= left_out))
        total = np.maximum(seen.sum(1, keepdims=True) - left_out, 0)
        t[:] = (np.maximum(seen - left_out - DISCOUNT, 0) + (DISCOUNT * kinds + 1) * share) / (total + 1)
    return share.astype(np.float32), out.reshape(TABLES, rows * rows)


class Mixture:
    """Forward and backward passes over consecutive blocks."""

    def __init__(self, shape: Shape, flat: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        self.shape, self.flat = shape, flat.astype(np.float32)
        self.each, self.place = shape.unpack(self.flat)
        self.share, self.value = table
        self.ones = np.ones(2 * shape.step, np.float32)
        self.held: dict[int, tuple] = {}

    def _room(self, n: int) -> tuple:
        """Arrays for ``n`` blocks, kept from one call to the next."""
        if n not in self.held:
            if len(self.held) > 3:
                self.held.clear()
            size = (n, self.shape.step, 2 * self.shape.step)
            self.held[n] = np.empty((n, 2 * self.shape.step), np.int64), np.empty(size, np.int64), np.empty(size, np.float32), np.empty(size, np.float32)
        return self.held[n]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Queries, keys and sinks of all rows, and what each place's weight is multiplied by."""
        k = self.shape.key
        sink = np.exp(np.clip(self.each[:, -1], -_MOST, _MOST))
        return self.each[:, :k].copy(), self.each[:, k : 2 * k].copy(), sink, np.exp(np.clip(self.place, -_MOST, _MOST))[self.shape.distance] * self.shape.causal

    def forward(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, tables: tuple):
        """Queries, keys, weights before division, weights times values, and sums over the window; arrays are overwritten by the next call."""
        step, rows, (query, key, sinks, place) = self.shape.step, self.shape.rows, tables
        both, cell, a, p = self._room(len(x))
        both[:, step:] = x
        both[1:, :step] = x[:-1]
        both[0, :step] = 0
        q, k, sink = query.take(x, 0), key.take(both, 0), sinks.take(x)
        np.matmul(q, k.swapaxes(1, 2), out=a)
        np.clip(a, -_MOST / 2, _MOST / 2, out=a)
        np.exp(a, out=a)
        a *= place
        a[first, :, :step] = 0
        both *= rows
        np.add(both[:, None], y[:, :, None], out=cell)
        near, next_, far = self.value[1], self.value[0], self.value[2]
        far.take(cell, out=p, mode="clip")
        line, at = p.reshape(len(x), -1), cell.reshape(len(x), -1)
        here, before = slice(step, None, 2 * step + 1), slice(step - 1, None, 2 * step + 1)  # diagonals: distances 0 and 1
        line[:, here] = next_.take(at[:, here])
        line[:, before] = near.take(at[:, before])
        p *= a
        total = (a.reshape(-1, 2 * step) @ self.ones).reshape(x.shape) + sink
        other = self.share.take(y) * sink
        return q, k, sink, a, p, total, (p.reshape(-1, 2 * step) @ self.ones).reshape(x.shape) + other, other

    def log_prob(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of the rows ``y`` after the rows ``x``; both (blocks, step), the first block a first."""
        out, tables = np.empty(x.shape, np.float32), self.tables()
        for i in range(0, len(x), BATCH):
            lead = 1 if i else 0  # the block before is context only
            at = slice(i - lead, i + BATCH)
            got = self.forward(x[at], y[at], first[at], tables)
            np.log(got[6][lead:] / got[5][lead:], out=out[i : i + BATCH])
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss over the ``real`` positions and its gradient."""
        step, key = self.shape.step, self.shape.key
        weight = real / np.float32(max(1, int(real.sum())))
        q, k, sink, a, p, total, hit, other = self.forward(x, y, first, self.tables())
        loss = -float((np.log(hit / total) * weight).sum())
        by_hit, by_total = weight / hit, weight / total
        p *= by_hit[:, :, None]
        a *= by_total[:, :, None]
        a -= p
        d = np.empty((*x.shape, self.shape.width), np.float32)
        d[..., :key] = a @ k
        dk = a.swapaxes(1, 2) @ q
        d[..., key : 2 * key] = dk[:, step:]
        d[:-1, :, key : 2 * key] += dk[1:, :step]
        d[..., -1] = sink * by_total - other * by_hit
        flat = np.zeros(self.shape.parameters, np.float32)
        each, place = self.shape.unpack(flat)
        at = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        ids = x.ravel()[at]
        edge = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        each[ids[edge]] = np.add.reduceat(d.reshape(-1, self.shape.width).take(at, 0), edge, 0)
        place[:] = np.bincount(self.shape.distance.ravel(), a.sum(0).ravel(), 2 * step)
        return loss, flat
