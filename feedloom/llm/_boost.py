"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth grown level by level on the gradient of the log-loss."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, f = x.shape
        weight = np.ones(n) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(f)], 1)
        self.start = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
        score = np.full(n, self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                m, first = 1 << level, (1 << level) - 1
                best = np.full(m, 1e-6)
                total_g, total_h = np.bincount(node, g, m), np.bincount(node, h, m)
                whole = total_g**2 / (total_h + self.ridge)
                for j in range(f):
                    if not len(self.edges[j]):
                        continue
                    key, width = node * (self.bins + 1) + b[:, j], self.bins + 1
                    left_g = np.bincount(key, g, m * width).reshape(m, width).cumsum(1)[:, : len(self.edges[j])]
                    left_h = np.bincount(key, h, m * width).reshape(m, width).cumsum(1)[:, : len(self.edges[j])]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge) - whole[:, None]
                    gain[(left_h < 1) | (right_h < 1)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(m), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + m][better] = j
                    cut[first : first + m][better] = self.edges[j][at[better]]
                own = first + node
                node = 2 * node + (x[np.arange(n), feature[own]] > cut[own])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            score = score + value[node]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[own]] > cut[own])
            out += value[node]
        return out
