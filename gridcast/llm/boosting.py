"""Gradient-boosted trees for a binary label, on histograms of binned columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth; a node without a split sends all rows left."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[:-1], method="lower"))
    return (values[1:] + values[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32, rate: float = 0.2, least: float = 5.0, penalty: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; deterministic."""
    edges = [_edges(c, bins) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    z = np.full(len(y), start)
    model = Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            _split_level(model, t, first, width, node - first, binned, edges, g, h, bins + 1, least, penalty)
            chosen = model.feature[t, node]
            node = 2 * node + 1 + (x[np.arange(len(y)), chosen] > model.threshold[t, node])
        place = node - (2**depth - 1)
        sums = [np.bincount(place, v, 2**depth) for v in (g, h)]
        model.leaf[t] = rate * sums[0] / (sums[1] + penalty)
        z += model.leaf[t, place]
    return model


def _split_level(model, t, first, width, place, binned, edges, g, h, bins, least, penalty) -> None:
    best = np.full(width, 1e-6)
    for f in range(binned.shape[1]):
        cell = place * bins + binned[:, f]
        left_g, left_h = (np.cumsum(np.bincount(cell, v, width * bins).reshape(width, bins), 1) for v in (g, h))
        all_g, all_h = left_g[:, -1:], left_h[:, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
        gain[(left_h < least / 4) | (right_h < least / 4)] = 0
        gain = gain[:, : len(edges[f])]
        if not gain.shape[1]:
            continue
        at = gain.argmax(1)
        top = gain[np.arange(width), at]
        for k in np.flatnonzero(top > best):
            best[k] = top[k]
            model.feature[t, first + k], model.threshold[t, first + k] = f, edges[f][at[k]]
