"""Generalised additive model with pairwise interactions, for two classes.

Features are cut into bins. Shallow trees are boosted in cycles, one feature after another, each tree on the bins of
its feature alone, so all trees of a feature add up to one table of bins. Then the pairs of features with the
largest gain on what is left are boosted likewise, in tables of two features' bins. A score is the sum of the
intercept and one look-up per table. Rounds end when a part of the rows kept aside no longer gains.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np

BINS = 64
PAIR_BINS = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _log_loss(y: np.ndarray, logit: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit)) if len(y) else 0.0


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """At most `bins` - 1 ascending cuts; a bin is closed above by its cut."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower")) if len(values) else np.zeros(0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values per bin of a tree with at most `leaves` leaves over ordered bins, from their gradients and hessians.

    Leaves are split by largest gain; both sides of a split keep at least `least` of hessian.
    """
    total_g, total_h = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]

    def gain(low: int, high: int) -> tuple[float, int]:
        if high - low < 2:
            return 0.0, low
        cuts = np.arange(low + 1, high)
        left_g, left_h = total_g[cuts] - total_g[low], total_h[cuts] - total_h[low]
        all_g, all_h = total_g[high] - total_g[low], total_h[high] - total_h[low]
        right_g, right_h = all_g - left_g, all_h - left_h
        better = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
        better = np.where((left_h >= least) & (right_h >= least), better, 0.0)
        at = int(better.argmax())
        return float(better[at]), int(cuts[at])

    parts = [(*gain(0, len(g)), 0, len(g))]
    while len(parts) < leaves:
        parts.sort(key=lambda p: -p[0])
        best, cut, low, high = parts[0]
        if best <= 1e-9:
            break
        parts[:1] = [(*gain(low, cut), low, cut), (*gain(cut, high), cut, high)]
    out = np.zeros(len(g))
    for _, _, low, high in parts:
        out[low:high] = (total_g[high] - total_g[low]) / (total_h[high] - total_h[low] + ridge)
    return out


def best_quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, int, np.ndarray]:
    """(gain, cut, cut, values) of the best cut of both features at once, over a table of bins."""

    def corner(table: np.ndarray) -> np.ndarray:
        return table.cumsum(0).cumsum(1)

    cg, ch = corner(g), corner(h)
    gs = [cg[:-1, :-1], cg[:-1, -1:] - cg[:-1, :-1], cg[-1:, :-1] - cg[:-1, :-1]]
    hs = [ch[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]]
    gs.append(cg[-1, -1] - sum(gs))
    hs.append(ch[-1, -1] - sum(hs))
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs))
    if not gain.size:
        return 0.0, 0, 0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [float((a / (b + ridge))[i, j]) for a, b in zip(gs, hs)]
    table = np.empty_like(g)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :] = value[0], value[1]
    table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = value[2], value[3]
    return float(gain[i, j]) - float(cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), int(i), int(j), table


@dataclass
class AdditiveModel:
    """`edges` and `tables` per feature; `pair_edges` coarser, `pairs` with their tables."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j])]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return _sigmoid(self.logit(x))


def train(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 300,
    rate: float = 0.1,
    leaves: int = 3,
    n_pairs: int = 6,
    ridge: float = 1.0,
    least: float = 1.0,
    patience: int = 20,
) -> AdditiveModel:
    """Fit on features `x` (rows x features) and classes `y` (0 or 1), in the order given: every fifth row is kept
    aside to end the rounds. Without rows, or with one class only, the score is a smoothed share."""
    y = y.astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return model
    features = x.shape[1]
    model.edges = [quantile_edges(x[:, j], BINS) for j in range(features)]
    model.pair_edges = [quantile_edges(x[:, j], PAIR_BINS) for j in range(features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)], 1)
    coarse = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)], 1)
    aside = np.arange(len(y)) % 5 == 4
    inside = ~aside
    logit = np.full(len(y), model.intercept)

    def boost(tables: list[np.ndarray], cells: list[np.ndarray], grow) -> None:
        """Cycles over the tables; ends with the tables of the best round."""
        nonlocal logit
        best, kept, kept_logit, waited = _log_loss(y[aside], logit[aside]), [t.copy() for t in tables], logit.copy(), 0
        for _ in range(rounds):
            for table, cell in zip(tables, cells):
                p = _sigmoid(logit)
                g = np.bincount(cell[inside], (y - p)[inside], table.size)
                h = np.bincount(cell[inside], (p * (1 - p))[inside], table.size)
                step = rate * grow(g.reshape(table.shape), h.reshape(table.shape))
                table += step
                logit = logit + step.ravel()[cell]
            now = _log_loss(y[aside], logit[aside])
            if now < best - 1e-6:
                best, kept, kept_logit, waited = now, [t.copy() for t in tables], logit.copy(), 0
            else:
                waited += 1
                if waited >= patience:
                    break
        for table, good in zip(tables, kept):
            table[:] = good
        logit = kept_logit

    boost(model.tables, [bins[:, j] for j in range(features)], lambda g, h: shallow_tree(g, h, leaves, ridge, least))
    gains = []
    for a, b in itertools.combinations(range(features), 2):
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        if min(shape) > 1:
            cell = coarse[inside, a] * shape[1] + coarse[inside, b]
            p = _sigmoid(logit[inside])
            g = np.bincount(cell, y[inside] - p, shape[0] * shape[1]).reshape(shape)
            h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
            gains.append((-best_quadrants(g, h, ridge)[0], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains)[:n_pairs]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    cells = [coarse[:, a] * t.shape[1] + coarse[:, b] for (a, b), t in zip(model.pairs, model.pair_tables)]
    boost(model.pair_tables, cells, lambda g, h: best_quadrants(g, h, ridge)[3])
    for j, table in enumerate(model.tables):  # tables add nothing on average; the intercept holds the mean
        mean = float(table[bins[:, j]].mean())
        table -= mean
        model.intercept += mean
    return model
