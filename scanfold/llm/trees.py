"""Small gradient-boosted trees for binary labels, in numpy, for bounded training samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf. A row goes left where its feature is <= the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(32):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            f = np.maximum(self.feature[at], 0)
            down = np.where(x[np.arange(len(x)), f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)
        return self.value[at]

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conditions (feature, is at most, threshold) that lead to each node but the root."""
        out: list[tuple[tuple[int, bool, float], ...]] = []

        def walk(i: int, path: tuple) -> None:
            if path:
                out.append(path)
            if self.feature[i] >= 0:
                f, t = int(self.feature[i]), float(self.threshold[i])
                walk(int(self.left[i]), (*path, (f, True, t)))
                walk(int(self.right[i]), (*path, (f, False, t)))

        walk(0, ())
        return out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Split points of each feature: midpoints of neighbouring values at its quantiles."""
    out = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        if len(v) > bins:
            v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * t.predict(x)
        return z

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x)) if len(x) else np.zeros(0)


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 8.0, ridge: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Logistic boosting with second-order splits over histograms; ``least`` is the least weight of a leaf."""
    w = np.ones(len(y)) if weight is None else weight
    prior = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Boosted(float(np.log(prior / (1 - prior))), rate, [])
    if not len(y) or y.min() == y.max():
        return model
    edges = _edges(x, bins)
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(y), model.base)
    for _ in range(trees):
        p = sigmoid(z)
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes.append([-1, 0.0, 0, 0, -gs / (hs + ridge)])
            if level == depth or w[rows].sum() < 2 * least:
                return me
            best = (1e-6, -1, -1)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, f]
                n = len(e) + 1
                gl, hl, wl = (np.cumsum(np.bincount(c, v[rows], n))[:-1] for v in (g, h, w))
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(wl < least) | (w[rows].sum() - wl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                f, k = best[1:]
                go = codes[rows, f] <= k
                nodes[me][0], nodes[me][1] = f, float(edges[f][k])
                nodes[me][2] = grow(rows[go], level + 1)
                nodes[me][3] = grow(rows[~go], level + 1)
            return me

        grow(np.arange(len(y)), 0)
        a = list(zip(*nodes, strict=True))
        tree = Tree(np.array(a[0], np.int64), np.array(a[1]), np.array(a[2], np.int64), np.array(a[3], np.int64), np.array(a[4]))
        model.trees.append(tree)
        z += rate * tree.predict(x)
    return model
