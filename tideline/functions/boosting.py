"""Gradient boosting of binary labels over binned features: what one task does with one bounded training set.

Newton steps of the logistic loss; every level of a tree takes, for all its nodes
at once, the best of all cuts between bins, found from sums of gradients by bin.
"""

from __future__ import annotations

import numpy as np


def bin_edges(x: np.ndarray, most: int = 255) -> list[np.ndarray]:
    """Of each feature the cuts: between all distinct values if they are few, else at quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > most:
            values = np.unique(np.quantile(column, np.linspace(0, 1, most), method="midpoint"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)


class Trees:
    """Full binary trees of one depth, node i's children being 2i+1 and 2i+2: feature, cut (infinite where a node does not part) and value."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range((len(value) + 1).bit_length() - 2):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.05, depth: int = 4, l2: float = 1.0, least: int = 40) -> Trees:
    edges = bin_edges(x)
    bins = binned(x, edges)
    n, width = bins.shape
    room = max((len(e) for e in edges), default=0) + 1
    has = np.arange(room - 1)[None, :] < np.array([len(e) for e in edges])[:, None]  # cuts that exist
    cell = (np.arange(width) * room)[None, :] + bins
    share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), (1 << depth) - 1
    features, cuts, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut, value = np.zeros(2 * inner + 1, np.int64), np.full(2 * inner + 1, np.inf), np.zeros(2 * inner + 1)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * room) + cell).ravel()
            sums = [np.bincount(at, None if w is None else np.repeat(w, width), nodes * width * room).reshape(nodes, width, room) for w in (g, h, None)]
            left_g, left_h, left_n = (s.cumsum(2)[:, :, :-1] for s in sums)
            all_g, all_h, all_n = (s.sum(2, keepdims=True) for s in sums)
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain = np.where((left_n >= least) & (all_n - left_n >= least) & has[None], gain, 0.0).reshape(nodes, -1)
            best = gain.argmax(1) if gain.shape[1] else np.zeros(nodes, np.int64)
            good = gain[np.arange(nodes), best] > 1e-12 if gain.shape[1] else np.zeros(nodes, bool)
            f, b = np.divmod(best, max(1, room - 1))
            for i in np.flatnonzero(good):
                feature[first + i], cut[first + i] = f[i], edges[f[i]][b[i]]
            own = node - first
            right = good[own] & (bins[np.arange(n), f[own]] > b[own])
            node = 2 * node + 1 + right
        low = node - inner
        value[inner:] = -rate * np.bincount(low, g, inner + 1) / (np.bincount(low, h, inner + 1) + l2)
        score += value[node]
        features.append(feature), cuts.append(cut), values.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(values))
