"""Gradient-boosted trees for two classes, on binned numeric features."""

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete trees: inner nodes test ``x[feature] > threshold``, leaves hold log-odds."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 4.0) -> Boosted:
    """Second-order boosting on the logistic loss; splits are at quantiles of each feature, no leaf has a weight below ``least``."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    score, inner = np.full(n, bias), 2**depth - 1
    features, thresholds, leaves = [], [], []
    flat = binned + np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2:
                    continue
                cells = flat[rows].reshape(-1)
                g = np.bincount(cells, np.repeat(slope[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(cells, np.repeat(curve[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                count = np.bincount(cells, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gain[(count < least) | (len(rows) - count < least)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-9 and b < len(cuts[f]):
                    feature[node], threshold[node] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = rate * np.bincount(at - inner, slope, inner + 1) / (np.bincount(at - inner, curve, inner + 1) + ridge)
        score += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Boosted(bias, np.stack(features), np.stack(thresholds), np.stack(leaves))
