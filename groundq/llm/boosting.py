"""Gradient-boosted trees for a binary label, and isotonic calibration, on dense features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """edges: bin borders of each feature; each tree is arrays of (feature, bin, left, right, value) by node."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1).astype("i2")

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.start)
        for feature, border, left, right, value in self.trees:
            node = np.zeros(len(x), "i4")
            while (inner := feature[node] >= 0).any():
                at = np.flatnonzero(inner)
                n = node[at]
                node[at] = np.where(b[at, feature[n]] <= border[n], left[n], right[n])
            out += value[node]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss; splits on quantile bins. A leaf has a hundredth of the rows, from 2 to 8, at least."""
    least = int(np.clip(len(y) // 100, 2, 8))
    edges = [np.unique(np.append(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]), 0.0)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    base = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(base / (1 - base))))
    if len(np.unique(y)) < 2:
        return model
    b, margin = model.binned(x), np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, border, left, right, value = [-1], [0], [0], [0], [0.0]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, level = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            value[node] = -rate * total_g / (total_h + ridge)
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = b[rows, f]
                    cg, ch, cn = (np.cumsum(np.bincount(at, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
                    gain[(cn < least) | (len(rows) - cn < least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
            if best[1] >= 0:
                low = b[rows, best[1]] <= best[2]
                feature[node], border[node], left[node], right[node] = best[1], best[2], len(feature), len(feature) + 1
                for part in (rows[low], rows[~low]):
                    todo.append((len(feature), part, level + 1))
                    for column, new in ((feature, -1), (border, 0), (left, 0), (right, 0), (value, 0.0)):
                        column.append(new)
            else:
                margin[rows] += value[node]
        model.trees.append(tuple(np.array(c) for c in (feature, border, left, right, value)))
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: ascending scores and the probabilities there, the means of the pooled rows."""
    order = np.argsort(score, kind="stable")
    means, sizes, firsts, lasts = [], [], [], []
    for s, v in zip(score[order], y[order], strict=True):
        means.append(float(v))
        sizes.append(1)
        firsts.append(s)
        lasts.append(s)
        while len(means) > 1 and (means[-2] >= means[-1] or lasts[-2] == firsts[-1]):
            n = sizes[-2] + sizes[-1]
            means[-2] = (means[-2] * sizes[-2] + means[-1] * sizes[-1]) / n
            sizes[-2], lasts[-2] = n, lasts[-1]
            for column in (means, sizes, firsts, lasts):
                column.pop()
    at, value = [], []
    for m, a, z in zip(means, firsts, lasts, strict=True):
        at += [a, z] if z > a else [a]
        value += [m, m] if z > a else [m]
    return np.array(at), np.array(value)


def calibrated(score: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(score, at, value), 0, 1) if len(at) else np.zeros(len(score))
