"""Gradient-boosted trees for small, bounded training sets: logistic loss, depth-limited, numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier. ``fit`` bins each feature by quantiles and grows ``rounds`` trees level by level."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        x = np.asarray(x, dtype=np.float64)
        y = np.asarray(y, dtype=np.float64)
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        nodes = 2**self.depth - 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            feature = np.full(nodes, -1)
            cut = np.zeros(nodes)
            at = np.zeros(n, dtype=np.int64)
            for v in range(nodes):
                own = np.flatnonzero(at == v)
                best = (1e-6, -1, 0)
                if len(own) >= 2 * self.least:
                    G, H = g[own].sum(), h[own].sum()
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        gs = np.bincount(code[own, j], g[own], len(cuts[j]) + 1).cumsum()[:-1]
                        hs = np.bincount(code[own, j], h[own], len(cuts[j]) + 1).cumsum()[:-1]
                        ns = np.bincount(code[own, j], minlength=len(cuts[j]) + 1).cumsum()[:-1]
                        gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                        gain[(ns < self.least) | (len(own) - ns < self.least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[v], cut[v] = best[1], cuts[best[1]][best[2]]
                    at[own] = 2 * v + 1 + (x[own, best[1]] > cut[v])
                else:
                    at[own] = 2 * v + 1
            leaf = at - nodes
            leaf = np.where(leaf < 0, 0, leaf)
            G = np.bincount(leaf, g, 2**self.depth)
            H = np.bincount(leaf, h, 2**self.depth)
            value = self.rate * G / (H + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        x = np.asarray(x, dtype=np.float64)
        score = np.full(len(x), self.base)
        if not len(x):
            return score
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[at]))
            score += value[at - len(feature)]
        return 1 / (1 + np.exp(-score))
