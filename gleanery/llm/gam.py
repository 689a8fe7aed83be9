"""A generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Fitting runs on the driver over a bounded matrix; a fitted model is a few lookup tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Gam:
    """Bin edges per feature, one table per feature and one per pair of features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: bins looked up and added, then squashed."""
        total = np.full(len(x), self.bias)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, i], side="right")]
        coarse = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.pair_edges)]
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between quantiles; equal values always share a bin."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """A tree of depth two over ordered bins: the step of every bin."""

    def split(lo: int, hi: int) -> list[tuple[int, int]]:
        if hi - lo < 2:
            return [(lo, hi)]
        gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        gr, hr = g[lo:hi].sum() - gl, h[lo:hi].sum() - hl
        gain = gl * gl / (hl + reg) + gr * gr / (hr + reg)
        cut = lo + 1 + int(np.argmax(gain))
        return [(lo, cut), (cut, hi)]

    parts = [(0, len(g))]
    for _ in range(2):
        parts = [p for lo, hi in parts for p in split(lo, hi)]
    step = np.empty(len(g))
    for lo, hi in parts:
        step[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + reg)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Gain over the whole and step table of the best cut of a 2-d histogram into four quadrants."""

    def sums(a: np.ndarray) -> list[np.ndarray]:
        c = a.cumsum(0).cumsum(1)
        top, left = c[:-1, -1:], c[-1:, :-1]
        inner = c[:-1, :-1]
        return [inner, top - inner, left - inner, c[-1, -1] - top - left + inner]

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = sums(g), sums(h)
    gain = sum(a * a / (b + reg) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [a[i, j] / (b[i, j] + reg) for a, b in zip(gs, hs)]
    step = np.empty(g.shape)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = value
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + reg)), step


def fit(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 64,
    pair_bins: int = 8,
    rounds: int = 150,
    pair_rounds: int = 60,
    n_pairs: int = 6,
    rate: float = 0.1,
    reg: float = 5.0,
) -> Gam:
    """Boost one tree per feature in turn, round after round; then the strongest pairs alike.

    No rows, or one class only: a model that gives every row the smoothed share of label 1
    (0.5 without rows). Not-a-number entries must be replaced by the caller.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Gam(float(np.log(share / (1 - share))), [], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.edges = [_edges(x[:, i], bins) for i in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    total = np.full(len(y), model.bias)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for i in range(n_features):
            r, w = residual()
            size = len(model.tables[i])
            step = rate * _tree(np.bincount(at[i], r, size), np.bincount(at[i], w, size), reg)
            model.tables[i] += step
            total += step[at[i]]

    model.pair_edges = [_edges(x[:, i], pair_bins) for i in range(n_features)]
    coarse = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def histograms(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[i] * size[j] + coarse[j]
        r, w = residual()
        return cell, *(np.bincount(cell, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (r, w))

    ranked = sorted(
        ((-_quadrants(*histograms(i, j)[1:], reg)[0], i, j) for i in range(n_features) for j in range(i + 1, n_features))
    )
    chosen = [(i, j) for _, i, j in ranked[:n_pairs]]
    tables = {p: np.zeros((size[p[0]], size[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for p in chosen:
            cell, g, h = histograms(*p)
            step = rate * _quadrants(g, h, reg)[1]
            tables[p] += step
            total += step.ravel()[cell]
    model.pairs = [(i, j, tables[i, j]) for i, j in chosen]
    return model
