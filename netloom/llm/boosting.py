"""Gradient-boosted trees for two classes, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(leaf) + 1]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 32, depth: int = 4, rate: float = 0.4, bins: int = 16, l2: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss, from even odds on."""
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(x):
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.zeros(len(x))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (at - first) * (len(c) + 1) + binned[:, j]
                gs = np.bincount(cell, g, width * (len(c) + 1)).reshape(width, -1)
                hs = np.bincount(cell, h, width * (len(c) + 1)).reshape(width, -1)
                gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
                ga, ha = gs.sum(axis=1)[:, None], hs.sum(axis=1)[:, None]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                k = gain.argmax(axis=1)
                for i in np.flatnonzero(gain[np.arange(width), k] > best + 1e-9):
                    best[i] = gain[i, k[i]]
                    out.features[t, first + i], out.thresholds[t, first + i] = j, c[k[i]]
            at = 2 * at + 1 + (x[np.arange(len(x)), out.features[t][at]] > out.thresholds[t][at])
        leaf = at - inner
        out.leaves[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += out.leaves[t][leaf]
    return out
