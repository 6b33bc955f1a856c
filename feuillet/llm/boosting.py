"""Gradient-boosted trees for a logistic loss over few features; fitted on a bounded sample, applied to whole columns."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # features and cuts by node, values by leaf
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            inner, leaves = 2**self.depth - 1, 2**self.depth
            feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows) >= 2 and (best := self._split(binned[rows], grad[rows], hess[rows], cuts)):
                    feature[node], cut[node] = best
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            leaf = at - inner
            g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
            value = self.rate * g / (h + self.l2)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def _split(self, binned, grad, hess, cuts):
        g, h = grad.sum(), hess.sum()
        best, found = 1e-6, None
        for j, edges in enumerate(cuts):
            if len(edges):
                gl, hl = (np.cumsum(np.bincount(binned[:, j], w, len(edges) + 1))[:-1] for w in (grad, hess))
                gain = gl**2 / (hl + self.l2) + (g - gl) ** 2 / (h - hl + self.l2) - g**2 / (h + self.l2)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = gain[k], (j, edges[k])
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            score += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
