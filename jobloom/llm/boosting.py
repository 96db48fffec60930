"""Boosted regression trees for a yes-or-no label over a bounded sample, and thresholds with a certified precision."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Trees of one depth fitted to the logistic loss by Newton steps over binned values; arrays only, so a model is a small broadcast."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.start = math.log(share / (1 - share))
        margin = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node, feature, cut = np.zeros(n, np.int64), [], []
            for level in range(self.depth):
                best = [(1e-6, 0, np.inf)] * (1 << level)
                for f in range(width):
                    if not len(cuts[f]):
                        continue
                    at, size = node * (self.bins + 1) + binned[:, f], (1 << level) * (self.bins + 1)
                    left_g, left_h = (np.cumsum(np.bincount(at, w, size).reshape(1 << level, -1), 1) for w in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                    k = gain[:, : len(cuts[f])].argmax(1)
                    for i, j in enumerate(k.tolist()):
                        if gain[i, j] > best[i][0]:
                            best[i] = (float(gain[i, j]), f, float(cuts[f][j]))
                fs, cs = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                feature.append(fs)
                cut.append(cs)
                node = 2 * node + (x[np.arange(n), fs[node]] > cs[node])
            leaf = -self.rate * np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.ridge)
            margin += leaf[node]
            self.trees.append((feature, cut, leaf))
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for fs, cs in zip(feature, cut, strict=True):
                node = 2 * node + (x[rows, fs[node]] > cs[node])
            out += leaf[node]
        return out


def calibrated(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities: a logistic fit on rows that the trees haven't seen, targets drawn in by their numbers."""
    good, bad = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w = np.stack([margin, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float, z: float = 1.645) -> float:
    """The least probability from which on the lower Wilson bound of the precision holds, at least a half; infinite where none does."""
    order = np.argsort(-p, kind="stable")
    n = np.arange(1, len(p) + 1)
    share = np.cumsum(y[order]) / n
    low = (share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    last = np.append(p[order][1:] < p[order][:-1], True)
    ok = np.flatnonzero((low >= precision) & last)
    return max(0.5, float(p[order][ok[-1]])) if len(ok) else math.inf
