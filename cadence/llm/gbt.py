"""Gradient-boosted trees for binary labels, kept as flat numpy node arrays.

Training (on a bounded sample, in memory) finds splits on quantile histograms
and honours monotonic constraints: +1 (-1) on a feature keeps the score from
falling (rising) as the feature grows, all else equal. A split that would break
its constraint is rejected, and the children of an accepted one are bounded by
the mean of their values, so the constraint holds for the whole tree. Scoring
walks all rows through a tree level by level with array lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees end to end; a leaf points to itself."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go_left = x[rows, self.feature[node]] <= self.cut[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(
    x: np.ndarray, y: np.ndarray, monotone: list[int], *, trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, ridge: float = 1.0, least: int = 5,
) -> Trees:
    """Fit to ``y`` in {0, 1}. ``least``: rows a leaf needs. Deterministic."""
    n, m = x.shape
    prior = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], axis=1) if n else np.zeros((0, m), int)
    width = bins + 1
    slot = binned + np.arange(m) * width
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def add(v: float) -> int:
        k = len(value)
        feature.append(0), cut.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def grow(rows: np.ndarray, lo: float, hi: float, level: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()  # noqa: B023
            node = add(rate * float(np.clip(-gs / (hs + ridge), lo, hi)))
            if level == depth or len(rows) < 2 * least:
                return node
            flat = slot[rows].ravel()
            hist = [np.bincount(flat, np.repeat(w, m), m * width).reshape(m, width).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]  # noqa: B023
            gl, hl, cl = (a[:, :-1] for a in hist)
            gr, hr, cr = gs - gl, hs - hl, len(rows) - cl
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
            gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - (gr * vr + 0.5 * (hr + ridge) * vr**2)
            whole = np.clip(-gs / (hs + ridge), lo, hi)
            gain += gs * whole + 0.5 * (hs + ridge) * whole**2
            sign = np.asarray(monotone)[:, None]
            bad = (cl < least) | (cr < least) | (sign * (vr - vl) < 0) | (np.arange(width - 1) >= np.array([len(c) for c in cuts])[:, None])
            gain = np.where(bad, -np.inf, gain)
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if not gain[f, b] > 1e-6:
                return node
            mid = (vl[f, b] + vr[f, b]) / 2
            up, down = (lo, hi), (lo, hi)
            if monotone[f] > 0:
                up, down = (lo, mid), (mid, hi)
            elif monotone[f] < 0:
                up, down = (mid, hi), (lo, mid)
            goes = binned[rows, f] <= b
            feature[node], cut[node] = f, cuts[f][b]
            left[node] = grow(rows[goes], *up, level + 1)
            right[node] = grow(rows[~goes], *down, level + 1)
            return node

        first = len(value)
        roots.append(grow(np.arange(n), -np.inf, np.inf, 0))
        part = Trees(np.array([first]), *(np.array(a) for a in (feature, cut, left, right, value)), 0.0, depth)
        margin += part.margin(x)
    ints = [np.array(a, np.int64) for a in (roots, feature, left, right)]
    return Trees(ints[0], ints[1], np.array(cut, float), ints[2], ints[3], np.array(value, float), base, depth)
