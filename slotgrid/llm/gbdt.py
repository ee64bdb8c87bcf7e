"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays; node i goes to `left[i]` if x[feature[i]] <= cut[i], else to `left[i]` + 1; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds: every row walks every tree one level at a time."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            feature = self.feature[node]
            right = x[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(feature < 0, node, self.left[node] + right)
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Forest:
    """Boosts logistic loss on `x` (n, d) and labels 0/1, or shares of ones, with `weights` (1 each if left out); cuts are quantiles, gains come from per-bin gradient sums. Deterministic."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], axis=1) if n else np.zeros((0, d), int)
    w = np.ones(n) if weights is None else weights
    p = np.clip((w * y).sum() / w.sum() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(n, base)
    feature, cut, left, value, roots = [], [], [], [], []

    def new(v: float) -> int:
        feature.append(-1), cut.append(0.0), left.append(len(left)), value.append(v)
        return len(feature) - 1

    for _ in range(trees if n else 0):
        q = 1 / (1 + np.exp(-f))
        g, h = w * (y - q), w * q * (1 - q)
        root = new(0.0)
        roots.append(root)
        open_nodes = [(root, np.arange(n))]
        for level in range(depth + 1):
            following = []
            for node, rows in open_nodes:
                gs, hs = g[rows].sum(), h[rows].sum()
                best, at = 1e-6, None
                whole = w[rows].sum()
                if level < depth and whole >= 2 * least:
                    for j in range(d):
                        size = len(edges[j]) + 1
                        if size < 2:
                            continue
                        b = binned[rows, j]
                        gc, hc, nc = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (g[rows], h[rows], w[rows]))
                        gain = gc**2 / (hc + ridge) + (gs - gc) ** 2 / (hs - hc + ridge) - gs**2 / (hs + ridge)
                        gain[(nc < least) | (whole - nc < least)] = 0
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, at = gain[k], (j, k)
                if at is None:
                    value[node] = rate * gs / (hs + ridge)
                    f[rows] += value[node]
                    continue
                j, k = at
                feature[node], cut[node] = j, float(edges[j][k])
                left[node] = new(0.0)
                new(0.0)
                go = binned[rows, j] <= k
                following += [(left[node], rows[go]), (left[node] + 1, rows[~go])]
            open_nodes = following
    arrays = [np.array(a, t) for a, t in ((feature, np.int64), (cut, float), (left, np.int64), (value, float), (roots, np.int64))]
    return Forest(*arrays, depth, base)
