"""Histogram gradient-boosted trees for two classes, flattened into arrays.

Fitting works on quantile bins: a level of a tree costs one histogram a feature. A fitted
ensemble is five flat arrays; prediction moves all rows through all trees together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """Node i sends a row to ``left[i]`` if its ``feature[i]`` is at most ``cut[i]``, else to
    ``right[i]``; a leaf points to itself and holds ``value[i]``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _edges(x: np.ndarray) -> np.ndarray:
    q = np.unique(np.quantile(x, np.linspace(0, 1, BINS)[1:-1], method="lower"))
    return q[q < x.max()] if len(x) else q


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 100, depth: int = 4, rate: float = 0.15, least: float = 10.0, l2: float = 1.0) -> Trees:
    """``least``: weight that a child needs. Ties between splits go to the first feature and cut."""
    x = np.asarray(x, np.float64)
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, np.float64)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    total = weight.sum()
    share = (weight @ y + 1) / (total + 2) if total else 0.5
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    edges = [_edges(x[:, f]) for f in range(x.shape[1])] if len(y) else []
    binned = [np.searchsorted(e, x[:, f], side="left").astype(np.int64) for f, e in enumerate(edges)]
    both = 0 < weight @ y < total
    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-12)
        node = np.zeros(len(y), np.int64)
        level = [_new(feature, cut, left, right, value)]
        roots.append(level[0])
        for d in range(depth + 1):
            n = len(level)
            gs, hs, ws = (np.bincount(node[node >= 0], v[node >= 0], n) for v in (g, h, weight))
            best = np.full(n, 1e-6)
            choice: list[tuple[int, int] | None] = [None] * n
            live = node >= 0
            for f, e in enumerate(edges if d < depth else []):
                if not len(e):
                    continue
                k = len(e) + 1
                key = node[live] * k + binned[f][live]
                hg, hh, hw = (np.bincount(key, v[live], n * k).reshape(n, k).cumsum(1)[:, :-1] for v in (g, h, weight))
                gain = hg**2 / (hh + l2) + (gs[:, None] - hg) ** 2 / (hs[:, None] - hh + l2) - (gs**2 / (hs + l2))[:, None]
                gain[(hw < least) | (ws[:, None] - hw < least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(n), b]
                for i in np.flatnonzero(top > best):
                    best[i], choice[i] = top[i], (f, int(b[i]))
            following, move = [], np.full((n, 2), -1, np.int64)
            for i, at in enumerate(level):
                if choice[i] is None:
                    value[at] = float(-rate * gs[i] / (hs[i] + l2))
                else:
                    f, b = choice[i]
                    feature[at], cut[at] = f, float(edges[f][b])
                    left[at], right[at] = _new(feature, cut, left, right, value), _new(feature, cut, left, right, value)
                    move[i] = len(following), len(following) + 1
                    following += [left[at], right[at]]
            new = np.full(len(y), -1, np.int64)
            for i, at in enumerate(level):
                mine = node == i
                if choice[i] is None:
                    margin[mine] += value[at]
                else:
                    f, b = choice[i]
                    new[mine] = np.where(binned[f][mine] <= b, move[i, 0], move[i, 1])
            node, level = new, following
            if not level:
                break
    return Trees(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, base)


def _new(feature: list, cut: list, left: list, right: list, value: list) -> int:
    at = len(feature)
    feature.append(0)
    cut.append(np.inf)
    left.append(at)
    right.append(at)
    value.append(0.0)
    return at
