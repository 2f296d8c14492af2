"""Gradient-boosted trees on a bounded sample, kept as flat node arrays, and isotonic calibration.

Training sees a matrix of a fixed number of rows on the driver; scoring runs on arrays inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; leaves hold values.

    A row goes right if its feature exceeds the threshold. A node that was not split has an infinite
    threshold, so every row goes left.
    """

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for every row of ``x``."""
        depth = int(self.value.shape[1]).bit_length() - 1
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - (len(value) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_boosted(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 64,
    least_weight: float = 2.0,
    shrink: float = 1.0,
    monotone: dict[int, int] | None = None,
) -> Forest:
    """Boosted trees for the logistic loss.

    ``monotone`` maps a feature to +1 or -1: the score never falls (rises) as it grows. A split that
    would break this is not made, and the middle of two children's values bounds all below them.
    With one class only, or without rows, the forest is the constant base score.
    """
    n, width = x.shape
    positives = float(y.sum())
    base = float(np.log((positives + 0.5) / (n - positives + 0.5)))
    leaves, inner = 1 << depth, (1 << depth) - 1
    if n == 0 or positives in (0.0, float(n)):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    sign = np.zeros(width, np.int64)
    for feature, way in (monotone or {}).items():
        sign[feature] = way
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], 1)
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature = np.zeros(inner, np.int64)
        threshold = np.full(inner, np.inf)
        low, high = np.full(2 * leaves - 1, -np.inf), np.full(2 * leaves - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            chosen: list[tuple[int, int, float] | None] = [None] * count
            own = at - first
            for f in range(width):
                if not len(edges[f]):
                    continue
                cells = len(edges[f]) + 1
                key = own * cells + binned[:, f]
                gs = np.cumsum(np.bincount(key, g, count * cells).reshape(count, cells), 1)
                hs = np.cumsum(np.bincount(key, h, count * cells).reshape(count, cells), 1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gr, hr = ga - gl, ha - hl
                lo, hi = low[first : first + count, None], high[first : first + count, None]
                wl, wr = np.clip(-gl / (hl + shrink), lo, hi), np.clip(-gr / (hr + shrink), lo, hi)
                whole = np.clip(-ga / (ha + shrink), lo, hi)

                def loss(gain_g: np.ndarray, gain_h: np.ndarray, w: np.ndarray) -> np.ndarray:
                    return gain_g * w + 0.5 * (gain_h + shrink) * w * w

                gain = loss(ga, ha, whole) - loss(gl, hl, wl) - loss(gr, hr, wr)
                bad = (hl < least_weight * 0.25) | (hr < least_weight * 0.25)
                if sign[f]:
                    bad |= sign[f] * (wr - wl) < 0
                gain[bad] = -1
                cut = np.argmax(gain, 1)
                top = gain[np.arange(count), cut]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    chosen[k] = (f, int(cut[k]), float((wl[k, cut[k]] + wr[k, cut[k]]) / 2))
            right = np.zeros(n, bool)
            for k, pick in enumerate(chosen):
                node = first + k
                low[2 * node + 1] = low[2 * node + 2] = low[node]
                high[2 * node + 1] = high[2 * node + 2] = high[node]
                if pick is None:
                    continue
                f, cut_at, middle = pick
                feature[node], threshold[node] = f, edges[f][cut_at]
                if sign[f] > 0:
                    high[2 * node + 1] = low[2 * node + 2] = middle
                elif sign[f] < 0:
                    low[2 * node + 1] = high[2 * node + 2] = middle
                right |= (own == k) & (binned[:, f] > cut_at)
            at = 2 * at + 1 + right
        leaf = at - inner
        weight = -np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + shrink)
        value = rate * np.clip(weight, low[inner:], high[inner:])
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


@dataclass
class Isotonic:
    """A non-decreasing step curve, linear between its steps."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.x, self.y)


def fit_isotonic(scores: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; without rows the curve is the identity."""
    if not len(scores):
        return Isotonic(np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first and last score
    for s, t in zip(scores[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and (
            blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]
        ):
            total, count, _, end = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
            blocks[-1][3] = end
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    return Isotonic(x, np.array([v for b in blocks for v in (b[0] / b[1],) * 2]))


def folds(n: int, parts: int) -> np.ndarray:
    """Fold of each row: they are dealt in turn."""
    return np.arange(n) % parts


def out_of_fold(x: np.ndarray, y: np.ndarray, parts: int = 3, **settings) -> np.ndarray:
    """Probability of each row by a forest that did not see it."""
    fold = folds(len(y), parts)
    out = np.zeros(len(y))
    for k in range(parts):
        out[fold == k] = fit_boosted(x[fold != k], y[fold != k], **settings).probability(x[fold == k])
    return out
