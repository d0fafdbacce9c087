"""Gradient-boosted regression trees for a binary label, with isotonic
calibration: a small numpy fit for a bounded sample of rows."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Tree:
    feature: np.ndarray  # per inner node, in level order; -1: no split, all rows go left
    threshold: np.ndarray  # rows above it go right
    value: np.ndarray  # per leaf


@dataclass(frozen=True)
class Boosted:
    start: float
    depth: int
    trees: tuple[Tree, ...]
    #: Isotonic calibration: margins and the probabilities they stand for.
    at: np.ndarray
    probability: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = t.feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > t.threshold[node]))
            out += t.value[node - (2**self.depth - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return np.interp(self.margin(x), self.at, self.probability)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit (pool adjacent violators) of label on
    score: the ends of its steps.  A step's mean is shrunk by half a row of each
    label, so that a calibrated score is never quite 0 or 1."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order].astype(float)
    blocks: list[list[float]] = []  # sum, rows, first, last
    for at, v in zip(s.tolist(), y.tolist(), strict=True):
        blocks.append([v, 1.0, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, rows, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += rows
            blocks[-1][3] = last
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    p = np.repeat([(b[0] + 0.5) / (b[1] + 1) for b in blocks], 2)
    return at, np.maximum.accumulate(p)


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 8) -> Boosted:
    """Boosting with Newton steps on the logistic loss over quantile bins.  The
    calibration is fitted on every fifth row, which the trees don't see."""
    held = np.arange(len(x)) % 5 == 0
    if len(x) < 50 or y[~held].min() == y[~held].max():
        held[:] = False
    tx, ty = x[~held], y[~held].astype(float)
    base = float(np.clip(ty.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(base / (1 - base)))
    edges = [np.unique(np.quantile(tx[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, tx[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, trees = np.full(len(tx), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = ty - p, p * (1 - p)
        inner = 2**depth - 1
        feature, threshold = np.full(inner, -1), np.zeros(inner)
        node = np.zeros(len(tx), dtype=np.int64)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            best = 1e-6
            if len(rows) >= 2 * least:
                g, h = gradient[rows], curve[rows]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    sums = [np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g, h, np.ones(len(rows)))]
                    gl, hl, nl = sums
                    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[n], threshold[n] = float(gain[k]), f, e[k]
            right = (tx[rows, feature[n]] > threshold[n]) if feature[n] >= 0 else np.zeros(len(rows), dtype=bool)
            node[rows] = 2 * n + 1 + right
        leaf = node - inner
        g = np.bincount(leaf, weights=gradient, minlength=2**depth)
        h = np.bincount(leaf, weights=curve, minlength=2**depth)
        value = rate * g / (h + ridge)
        margin += value[leaf]
        trees.append(Tree(feature, threshold, value))
    raw = Boosted(start, depth, tuple(trees), np.zeros(1), np.zeros(1))
    at, probability = isotonic(raw.margin(x[held]), y[held]) if held.any() else isotonic(raw.margin(x), y)
    return Boosted(start, depth, tuple(trees), at, probability)
