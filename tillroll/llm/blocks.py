"""Names of byte strings by doubling, and the sampled positions that stand for all windows of a text.

The name of a string of length 2n comes from the names of its two halves, as in prefix doubling, so
equal strings have equal names; other lengths are covered by blocks that overlap. Names are 64-bit
hashes in place of dense ranks: they need no global order.

A window's anchor is the position of the smallest 16-byte name among its first REACH positions
(leftmost of equals). It depends on the window's bytes alone: equal windows have equal anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 16
POSITIONS = 1 << 16  # positions named at once; such arrays stay in a core's cache

_RANDOM = np.random.default_rng(20240229)
_ODD = [np.uint64(int(x) | 1) for x in _RANDOM.integers(2**62, 2**63, 3, dtype=np.int64)]


def _pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Name of the pair of names."""
    h = a * _ODD[seed]
    h ^= h >> np.uint64(31)
    h += (b << np.uint64(23)) ^ (b >> np.uint64(41))
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    h *= _ODD[seed + 1]
    h ^= h >> np.uint64(32)
    return h


def block_names(data: np.ndarray) -> np.ndarray:
    """Name of the 16 bytes at each position that has them; eight bytes are their own name."""
    n = len(data) - BLOCK // 2 + 1
    if n <= BLOCK // 2:
        return np.zeros(0, np.uint64)
    halves = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    return _pair(halves[: -BLOCK // 2], halves[BLOCK // 2 :])


def names_at(blocks: np.ndarray, starts: np.ndarray, length: int | np.ndarray, seed: int = 0) -> np.ndarray:
    """Names of the strings of `length` bytes (at least 16, one for all or one for each) at `starts`."""
    most = int(np.max(length, initial=BLOCK))
    out = blocks[starts]
    for at in range(BLOCK, most, BLOCK):
        last = length - BLOCK
        more = at < last + BLOCK  # a further block begins before the end
        step = np.minimum(at, last)
        new = _pair(out, blocks[starts + np.maximum(step, 0)], seed)
        out = new if np.ndim(length) == 0 else np.where(more, new, out)
    return out


def _smallest(names: np.ndarray, reach: int) -> np.ndarray:
    """Position of the smallest name among `reach` positions from each one on, leftmost of equals."""
    n = len(names) - reach + 1
    # upper bits of the name, then the position: the minimum is the leftmost smallest
    low = np.uint64((1 << 21) - 1)
    keyed = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    groups = -(-len(keyed) // reach)
    padded = np.full(groups * reach, ~np.uint64(0))
    padded[: len(keyed)] = keyed
    padded = padded.reshape(groups, reach)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[reach - 1 : reach - 1 + n]) & low).astype(np.int64)


def anchors(
    data: np.ndarray, offsets: np.ndarray, window: int, reach: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(block names, anchors, least start, greatest start, first position) for parts of a slice.

    Positions are relative to the first position of the part. The starts of all windows that lie
    within a document are dealt to anchors; a document that is longer than a part is cut into parts,
    and no start is left out or given twice.
    """
    assert reach + BLOCK - 1 <= window and POSITIONS + 2 * window < 1 << 21
    for begin in range(0, max(len(data) - window + 1, 0), POSITIONS):
        part = data[begin : begin + POSITIONS + window - 1]
        blocks = block_names(part)
        if len(blocks) < reach:
            continue
        picks = _smallest(blocks, reach)[: len(part) - window + 1]
        starts = np.arange(len(picks))
        document_end = offsets[np.searchsorted(offsets, starts + begin, "right")] - begin
        inside = starts + window <= document_end
        starts, picks = starts[inside], picks[inside]
        if not len(starts):
            continue
        head = np.flatnonzero(np.r_[True, (picks[1:] != picks[:-1]) | (np.diff(starts) != 1)])
        tail = np.r_[head[1:], len(starts)] - 1
        yield blocks, picks[head], starts[head], starts[tail], begin
