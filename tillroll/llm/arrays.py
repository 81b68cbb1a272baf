"""Arrow columns as flat byte buffers, and numpy helpers over them.

Texts of a batch are looked at as one UTF-8 buffer with document offsets, in
slices of bounded size, so that the cost per document stays small and memory
does not depend on how many rows Spark puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of consecutive rows of about `limit` bytes.

    Null texts count as empty. A longer text forms a slice of its own.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        low = int(offsets[at])
        yield at, end, data[low : int(offsets[end])], offsets[at : end + 1] - low
        at = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true values; no run crosses a document border."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    first[inner] = mask[inner]
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def document_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the document that each byte position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values in each run."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


class CodePoints:
    """Byte positions of a slice as code points within their documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=self.before[1:])
        self.offsets = offsets

    def of(self, positions: np.ndarray, documents: np.ndarray) -> np.ndarray:
        return self.before[positions] - self.before[self.offsets[documents]]


def byte_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table
