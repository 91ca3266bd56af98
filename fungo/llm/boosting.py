"""Gradient boosting of small trees in numpy, for models fitted on a bounded sample on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Logistic boosting; each tree is full, with one (feature, bound) per inner node and a step per leaf."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    penalty: float = 1.0
    start: float = 0.0
    fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        bounds = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 32), method="lower")) for c in x.T]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = sigmoid(score)
            grad, curve = y - p, p * (1 - p)
            feature, bound = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            at = np.zeros(len(y), np.int64)
            for node in range(len(feature)):
                rows = np.flatnonzero(at == node)
                if len(rows):
                    feature[node], bound[node] = self.split(x[rows], grad[rows], curve[rows], bounds)
                    at[rows] = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            leaf = at - len(feature)
            g, h = (np.bincount(leaf, v, 1 << self.depth) for v in (grad, curve))
            step = self.rate * g / (h + self.penalty)
            self.fitted.append((feature, bound, step))
            score += step[leaf]
        return self

    def split(self, x, grad, curve, bounds) -> tuple[int, float]:
        total_g, total_h = grad.sum(), curve.sum()
        best = (1e-9, 0, np.inf)
        for f, cut in enumerate(bounds):
            low = np.searchsorted(cut, x[:, f], "left")
            g = np.cumsum(np.bincount(low, grad, len(cut) + 1))[:-1]
            h = np.cumsum(np.bincount(low, curve, len(cut) + 1))[:-1]
            gain = g**2 / (h + self.penalty) + (total_g - g)**2 / (total_h - h + self.penalty) - total_g**2 / (total_h + self.penalty)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, float(cut[i]))
        return best[1], best[2]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bound, step in self.fitted:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += step[at - len(feature)]
        return out
