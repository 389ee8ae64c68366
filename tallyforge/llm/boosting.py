"""Gradient-boosted trees over binned dense features, and isotonic calibration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: by tree and inner node a feature and a threshold, by leaf a value."""

    depth: int
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, penalty: float = 2.0, least: float = 3.0, ways: Sequence[int] | None = None) -> Trees:
    """Logistic loss, second-order gains, histograms of binned features.

    ways: by feature, 1 if a split may only give more to its larger values, -1 if only less, 0 if either.
    """
    n, m = x.shape
    way = np.array(ways if ways is not None else [0] * m)[:, None]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    # many features are 0 in most rows: the quantiles of what is above it cut finer
    cuts = [np.unique(np.concatenate([[0.0], c, np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, 17)[:-1])])) if (x[:, j] > 0).any() else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    wide = int(binned.max()) + 1
    flat = binned + np.arange(m) * wide
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    trees = Trees(depth, float(np.log(share / (1 - share))))
    z = np.full(n, trees.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = (node - first)[:, None] * (m * wide) + flat
            size = count * m * wide
            gs = np.bincount(at.ravel(), np.repeat(g, m), minlength=size).reshape(count, m, wide).cumsum(2)
            hs = np.bincount(at.ravel(), np.repeat(h, m), minlength=size).reshape(count, m, wide).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + penalty) + (ga - gs) ** 2 / (ha - hs + penalty) - ga**2 / (ha + penalty)
            gain[(hs < least) | (ha - hs < least)] = 0
            rise = gs / (hs + penalty) - (ga - gs) / (ha - hs + penalty)  # of the larger values' part over the other
            gain[way * rise < 0] = 0
            for k in range(count):
                j, b = divmod(int(gain[k].argmax()), wide)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + k], t[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - (2**depth - 1)
        gl, hl = np.bincount(leaf, g, minlength=2**depth), np.bincount(leaf, h, minlength=2**depth)
        v = -rate * gl / (hl + penalty)
        trees.feature.append(f)
        trees.threshold.append(t)
        trees.value.append(v)
        z += v[leaf]
    return trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing fit: pool neighbours that violate the order."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2]])
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def calibrated(score: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Between the steps' first scores the fit is interpolated."""
    return np.interp(score, *steps) if len(steps[0]) else np.full(len(score), 0.5)
