"""Gradient-boosted regression trees for a yes/no label, small enough to fit on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Boosted:
    """Trees as full binary heaps: feature and cut of inner nodes (feature -1 ends a branch), value of leaves."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, 2 * at + 1 + right, at)
            out += value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, least: float = 5.0, ridge: float = 1.0, cuts: int = 32) -> Boosted:
    """Newton boosting on the logistic loss; every feature is cut at up to `cuts` quantiles."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, cuts + 1)[:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    width = cuts + 1  # bins of a feature at most; all features' histograms are made at once
    flat = binned + np.arange(x.shape[1]) * width
    usable = np.arange(width - 1) < np.array([len(e) for e in edges])[:, None]
    score = np.full(len(x), model.base)
    for _ in range(rounds):
        p = sigmoid(score)
        grad, hess = y - p, p * (1 - p)
        nodes = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(x), np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = rate * g / (h + ridge)
            best = (1e-6, -1, 0)
            if node < 2**depth - 1:
                own = flat[rows].ravel()
                left = lambda v: np.cumsum(np.bincount(own, np.repeat(v, x.shape[1]), width * x.shape[1]).reshape(-1, width), axis=1)[:, :-1]  # noqa: B023, E731
                left_g, left_h = left(grad[rows]), left(hess[rows])
                gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                gain[~usable | (left_h < least / 4) | (h - left_h < least / 4)] = 0
                f, c = np.unravel_index(gain.argmax(), gain.shape)
                best = max(best, (float(gain[f, c]), int(f), int(c)))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], edges[best[1]][best[2]]
                at[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
        score += value[at]
        model.trees.append((feature, cut, value))
    return model
