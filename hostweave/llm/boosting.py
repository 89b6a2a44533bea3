"""Small gradient-boosted trees and isotonic calibration for bounded training samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Trees of equal depth over raw features, stored as heaps: node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(feature) and node[:1].size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 2.0
) -> Trees:
    """Boost trees on the logistic loss, splitting at quantiles of each feature."""
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    found = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            split = np.full(width, bins)
            for j in range(x.shape[1]):
                cell = at * bins + binned[:, j]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1.0) | (ht - hs < 1.0)] = 0
                gain[:, len(cuts[j]) :] = 0
                pick = gain.argmax(1)
                value = gain[np.arange(width), pick]
                better = value > best + 1e-9
                best[better], split[better] = value[better], pick[better]
                feature[first : first + width][better] = j
                threshold[first : first + width][better] = np.asarray(cuts[j])[pick[better]] if better.any() else 0
            right = x[np.arange(len(y)), feature[node]] > threshold[node]
            node = 2 * node + 1 + right
        cell = node - inner
        leaf = rate * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + ridge)
        margin += leaf[cell]
        for kept, one in zip(found, (feature, threshold, leaf), strict=True):
            kept.append(one)
    model.feature, model.threshold, model.leaf = (np.array(f) for f in found)
    return model


@dataclass
class Isotonic:
    """Non-decreasing map from margins to probabilities, linear between its points."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators; each pool's share is pulled towards one half by ``prior`` rows, so it never is 0 or 1."""
    if not len(y):
        return Isotonic(np.array([-30.0, 30.0]), 1 / (1 + np.exp(np.array([30.0, -30.0]))))
    order = np.argsort(margin, kind="stable")
    at, which = np.unique(margin[order], return_inverse=True)
    ones, n = np.bincount(which, y[order]), np.bincount(which).astype(float)
    pools: list[list[float]] = []
    for a, o, c in zip(at, ones, n, strict=True):
        pools.append([a, a, o, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, o2, c2 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + o2, pools[-1][3] + c2]
    values = [(o + prior / 2) / (c + prior) for _, _, o, c in pools]
    values = np.maximum.accumulate(values)
    return Isotonic(np.array([e for p in pools for e in p[:2]]), np.repeat(values, 2))
