"""Gradient-boosted trees in numpy: histogram splits, logistic loss, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees' nodes in one set of arrays; a leaf's feature is -1 and its children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches: every level of every tree in one step."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            goes_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(goes_left, self.left[node], self.right[node]))
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, l2: float = 1.0) -> Trees:
    """monotone: feature -> +1 (the score may only rise with it) or -1 (only fall). One class only, or no rows: a
    constant model."""
    if not len(y):
        return Trees(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), 0, 20.0)
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    bias, width = float(np.log(p / (1 - p))), x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(len(y), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, levels: int, low: float, high: float) -> int:
        me = len(feature)
        own = float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))
        for a, v in ((feature, -1), (threshold, 0.0), (left, me), (right, me), (value, own * rate)):
            a.append(v)
        best = None
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(width if levels and len(rows) >= 2 * least else 0):
            n = len(cuts[j]) + 1
            at = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(at, w, n))[:-1] for w in (g[rows], h[rows], None))
            wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
            gain = -(gl * wl + (hl + l2) * wl**2 / 2) - ((gs - gl) * wr + (hs - hl + l2) * wr**2 / 2) + gs * own + (hs + l2) * own**2 / 2
            ok = (nl >= least) & (len(rows) - nl >= least) & ((wr - wl) * monotone.get(j, 0) >= 0)
            if ok.any() and (k := int(np.where(ok, gain, -np.inf).argmax())) >= 0 and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, wl[k], wr[k])
        if best:
            _, j, k, wl, wr = best
            mid, sign = (wl + wr) / 2, monotone.get(j, 0)
            goes = binned[rows, j] <= k
            feature[me], threshold[me] = j, float(cuts[j][k])
            left[me] = grow(rows[goes], g, h, levels - 1, max(low, mid) if sign < 0 else low, min(high, mid) if sign > 0 else high)
            right[me] = grow(rows[~goes], g, h, levels - 1, max(low, mid) if sign > 0 else low, min(high, mid) if sign < 0 else high)
        return me

    def flat() -> Trees:
        return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots, int), depth, bias)

    every = np.arange(len(y))
    for _ in range(trees if 0 < y.mean() < 1 else 0):
        q = 1 / (1 + np.exp(-score))
        roots.append(grow(every, q - y, q * (1 - q), depth, -np.inf, np.inf))
        one = flat()
        one.roots, one.bias = np.array(roots[-1:]), 0.0
        score += one.margin(x)
    if not roots:
        grow(every, np.zeros(len(y)), np.ones(len(y)), 0, -np.inf, np.inf)
        roots.append(0)
    return flat()
