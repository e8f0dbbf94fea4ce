"""Gradient-boosted trees for two classes, in numpy: histogram splits, Newton leaves, and a calibration of the scores."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting. `fit` is deterministic; a model is a few arrays, and its size is fixed by rounds and depth."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, prob * (1 - prob)
            feature, cut, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(2**self.depth)
            node = np.zeros(len(y), int)
            for n in range(inner):
                rows = node == n
                best, at = 1e-6, None
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c) or not rows.any():
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    if gain.max() > best:
                        best, at = gain.max(), (f, int(gain.argmax()))
                right = np.zeros(len(y), bool)
                if at:
                    feature[n], cut[n] = at[0], cuts[at[0]][at[1]]
                    right = binned[:, at[0]] > at[1]
                node[rows] = 2 * n + 1 + right[rows]
            node -= inner
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = -self.rate * gs / (hs + self.l2)
            score += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            out += leaf[node - len(feature)]
        return out


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities: a logistic fit on rows that the trees have not seen, to targets a little
    off 0 and 1 (by Laplace's rule), so that separable scores do not become certainties."""
    a, b, n = 1.0, 0.0, y.sum()
    y = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([((p - y) * score).mean(), (p - y).mean()])
        w = p * (1 - p) + 1e-6
        hess = np.array([[(w * score * score).mean(), (w * score).mean()], [(w * score).mean(), w.mean()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def threshold(prob: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which on the held-out precision is at least `precision` (above 1 where there is none)."""
    order = np.argsort(-prob, kind="stable")
    hit = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(hit >= precision)
    return float(prob[order][good[-1]]) if len(good) else 1.01
