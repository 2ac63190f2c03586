"""Gradient-boosted trees for two classes on numpy arrays of bounded size."""

import numpy as np

BINS = 32


class Boosted:
    """Complete trees of one depth over binned features; every node sends rows right above its bin."""

    def __init__(self, edges, features, cuts, leaves, bias):
        self.edges, self.features, self.cuts, self.leaves, self.bias = edges, features, cuts, leaves, bias

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the second class for each row."""
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((len(self.edges), 0), int)
        rows = np.arange(len(x))
        total = np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                at = feature[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = binned[np.maximum(at, 0), rows] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += leaf[node]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, smooth: float = 2.0, least: int = 5) -> Boosted:
    """Fit by second-order gains of the logistic loss on histograms of at most BINS bins per feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    size = 2 ** (depth + 1) - 1
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut, leaf = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            at = node - base
            live = (at >= 0) & (at < width)
            best_gain, best_feature, best_cut = np.full(width, 1e-6), np.full(width, -1), np.zeros(width, dtype=np.int64)
            for j, b in enumerate(binned):
                bins = len(edges[j]) + 1
                if bins == 1:
                    continue
                key = at[live] * bins + b[live]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g[live], h[live], np.ones(live.sum()))]
                left_g, left_h, left_n = (s[:, :-1] for s in sums)
                all_g, all_h, all_n = (s[:, -1:] for s in sums)
                gain = left_g**2 / (left_h + smooth) + (all_g - left_g) ** 2 / (all_h - left_h + smooth) - all_g**2 / (all_h + smooth)
                gain[(left_n < least) | (all_n - left_n < least)] = -1
                pick = gain.argmax(1)
                value = gain[np.arange(width), pick]
                better = value > best_gain
                best_gain[better], best_feature[better], best_cut[better] = value[better], j, pick[better]
            feature[base : base + width], cut[base : base + width] = best_feature, best_cut
            moved = node.copy()
            for n in np.flatnonzero(best_feature >= 0):
                rows = node == base + n
                moved[rows] = 2 * (base + n) + 1 + (binned[best_feature[n]][rows] > best_cut[n])
            node = moved
        sums = np.bincount(node, g, size), np.bincount(node, h, size)
        leaf = rate * sums[0] / (sums[1] + smooth)
        margin += leaf[node]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Boosted(edges, features, cuts, leaves, bias)
