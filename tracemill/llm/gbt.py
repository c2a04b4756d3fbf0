"""Gradient-boosted trees for a yes/no label, on binned features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: a node k has the children 2k+1 and 2k+2; `leaves` follow the splits."""

    feature: np.ndarray  # tree, node
    cut: np.ndarray
    leaves: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        n_splits = self.feature.shape[1]
        for feature, cut, leaves in zip(self.feature, self.cut, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < n_splits:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaves[at - n_splits]
        return out


def _halves(two: np.ndarray, high: np.ndarray, grad: np.ndarray, hess: np.ndarray, starts: np.ndarray, full: np.ndarray, g_all: np.ndarray, h_all: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, gradients and second derivatives of its lower half by node) of the columns of two values; rows are sorted by node."""
    if not len(two):
        return
    sums = [np.zeros((len(g_all), len(two))) for _ in range(2)]
    for out, weight in zip(sums, (grad, hess), strict=True):
        out[full] = np.add.reduceat(high * weight[:, None], starts, axis=0)
    for k, j in enumerate(two):
        yield int(j), g_all - sums[0][:, k], h_all - sums[1][:, k]


def train(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.2, n_bins: int = 32, penalty: float = 1.0) -> Trees:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    # Columns of two values are summed by node all at once.
    two = np.array([j for j, e in enumerate(edges) if len(e) == 1], np.int64)
    high = np.ascontiguousarray(binned[two].T.astype(float))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    n_splits, features, cuts, all_leaves = 2**depth - 1, [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(n_splits, np.int64), np.full(n_splits, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            low, count = 2**level - 1, 2**level
            own = at - low
            g_all, h_all = np.bincount(own, grad, minlength=count), np.bincount(own, hess, minlength=count)
            best = np.zeros(count)
            order = np.argsort(own, kind="stable")
            full = np.flatnonzero(np.bincount(own, minlength=count))
            starts = np.searchsorted(own[order], full)
            for j, g, h in _halves(two, high[order], grad[order], hess[order], starts, full, g_all, h_all):
                gain = g**2 / (h + penalty) + (g_all - g) ** 2 / (h_all - h + penalty) - g_all**2 / (h_all + penalty)
                for k in np.flatnonzero(gain > best + 1e-9):
                    best[k], feature[low + k], cut[low + k] = gain[k], j, edges[j][0]
            for j in range(width):
                if len(edges[j]) < 2:
                    continue
                key = own * n_bins + binned[j]
                g = np.bincount(key, grad, minlength=count * n_bins).reshape(count, n_bins).cumsum(1)[:, :-1]
                h = np.bincount(key, hess, minlength=count * n_bins).reshape(count, n_bins).cumsum(1)[:, :-1]
                gain = g**2 / (h + penalty) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + penalty) - (g_all**2 / (h_all + penalty))[:, None]
                where = gain[:, : len(edges[j])].argmax(1)
                top = gain[np.arange(count), where]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feature[low + k], cut[low + k] = top[k], j, edges[j][where[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - n_splits
        g, h = np.bincount(leaf, grad, minlength=n_splits + 1), np.bincount(leaf, hess, minlength=n_splits + 1)
        leaves = rate * g / (h + penalty)
        score += leaves[leaf]
        features.append(feature)
        cuts.append(cut)
        all_leaves.append(leaves)
    return Trees(np.array(features), np.array(cuts), np.array(all_leaves), base)
