"""A linear-chain conditional random field over token codes, in numpy batches.

The score of a labelling is the sum over tokens of weights by (code, label) for the token and
its two neighbours, and by (label, next label). Codes are small integers; a sequence is padded with -1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _gather(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 0)[..., None], table[np.maximum(codes, 0)], 0)


def _shifted(codes: np.ndarray, by: int) -> np.ndarray:
    out = np.full_like(codes, -1)
    if by > 0:
        out[:, by:] = codes[:, :-by]
    else:
        out[:, :by] = codes[:, -by:]
    return out


@dataclass
class LinearChain:
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return (
            _gather(self.here, codes)
            + _gather(self.before, _shifted(codes, 1))
            + _gather(self.after, _shifted(codes, -1))
        )

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Best labels of each row; ties to the smaller label. Padding stays at label 0."""
        rows, length = codes.shape
        score = self.emissions(codes)
        back = np.zeros((rows, length, score.shape[2]), np.int8)
        best = score[:, 0]
        for t in range(1, length):
            ways = best[:, None, :] + self.moves.T
            back[:, t] = ways.argmax(2)
            new = ways.max(2) + score[:, t]
            ends = codes[:, t] < 0
            back[ends, t] = np.arange(score.shape[2])
            best = np.where(ends[:, None], best, new)
        labels = np.zeros((rows, length), np.int8)
        at = best.argmax(1)
        for t in range(length - 1, -1, -1):
            labels[:, t] = at
            at = back[np.arange(rows), t, at]
        labels[codes < 0] = 0
        return labels


def train(codes: np.ndarray, labels: np.ndarray, n_codes: int, n_labels: int, steps: int = 60) -> LinearChain:
    """Penalised maximum likelihood by full-batch AdaGrad, gradients by forward and backward sums."""
    model = LinearChain(
        np.zeros((n_codes, n_labels)), np.zeros((n_codes, n_labels)), np.zeros((n_codes, n_labels)),
        np.zeros((n_labels, n_labels)),
    )
    rows, length = codes.shape
    known = codes >= 0
    views = (codes, _shifted(codes, 1), _shifted(codes, -1))
    tables = (model.here, model.before, model.after)
    truth = np.zeros((rows, length, n_labels))
    truth[np.arange(rows)[:, None], np.arange(length)[None, :], labels] = known
    pairs_known = known[:, 1:]
    true_moves = np.zeros_like(model.moves)
    np.add.at(true_moves, (labels[:, :-1][pairs_known], labels[:, 1:][pairs_known]), 1)
    past = [np.full_like(t, 1e-3) for t in (*tables, model.moves)]
    for _ in range(steps):
        score = model.emissions(codes)
        factor = np.exp(score - score.max(2, keepdims=True))
        step = np.exp(model.moves)
        alpha, beta = np.zeros_like(factor), np.ones_like(factor)
        norm = np.ones((rows, length, 1))
        for t in range(length):
            new = factor[:, t] if t == 0 else (alpha[:, t - 1] @ step) * factor[:, t]
            norm[:, t] = new.sum(1, keepdims=True)
            new = new / norm[:, t]
            alpha[:, t] = new if t == 0 else np.where(known[:, t, None], new, alpha[:, t - 1])
        weighted = np.zeros_like(factor)  # what a token passes to the one before it
        for t in range(length - 1, 0, -1):
            weighted[:, t] = known[:, t, None] * factor[:, t] * beta[:, t] / norm[:, t]
            beta[:, t - 1] = np.where(known[:, t, None], weighted[:, t] @ step.T, 1)
        gap = truth - alpha * beta * known[..., None]
        both = step * np.einsum("rti,rtj->ij", alpha[:, :-1], weighted[:, 1:])
        gradients = []
        for view, weights in zip(views, tables):
            g = np.zeros_like(weights)
            ok = view >= 0
            np.add.at(g, view[ok], gap[ok])
            gradients.append(g - 0.05 * weights)
        gradients.append(true_moves - both - 0.05 * model.moves)
        for weights, g, p in zip((*tables, model.moves), gradients, past):
            p += g * g
            weights += 0.5 * g / np.sqrt(p)
    return model
