"""Forests of BK-trees over 64-bit words, built and searched in numpy, level by level.

The children of a node are keyed by their integer Hamming distance to it. A search from a node at
distance d follows only the edges d - radius to d + radius. All trees of a batch are handled together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDE = 128  # more than any distance; node * WIDE + edge orders the edges of all nodes


class Forest:
    """One tree per value of `tree`; `words` of one tree are distinct, equal `tree` values adjacent."""

    def __init__(self, words: np.ndarray, tree: np.ndarray):
        self.words = words
        n = len(words)
        first = np.r_[True, tree[1:] != tree[:-1]] if n else np.zeros(0, bool)
        self.trees = tree[first]
        self.roots = np.flatnonzero(first)
        left = np.flatnonzero(~first)
        parent = self.roots[np.cumsum(first) - 1][left]
        edges, children = [], []
        while len(left):
            key = parent * WIDE + np.bitwise_count(words[left] ^ words[parent])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            head = np.r_[True, key[1:] != key[:-1]]
            edges.append(key[head])
            children.append(left[head])
            parent = left[head][np.cumsum(head) - 1][~head]
            left = left[~head]
        key = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edges = key[order]
        self.children = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def search(
        self, words: np.ndarray, tree: np.ndarray, radius: int, block: int = 1024
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of a query, node) of all pairs within the radius, for blocks of queries.

        Queries whose `tree` has no tree find nothing.
        """
        place = np.searchsorted(self.trees, tree)
        there = np.zeros(len(tree), bool)
        ok = place < len(self.trees)
        there[ok] = self.trees[place[ok]] == tree[ok]
        for at in range(0, len(words), block):
            query = np.flatnonzero(there[at : at + block]) + at
            node = self.roots[place[query]]
            out = []
            while len(query):
                d = np.bitwise_count(words[query] ^ self.words[node]).astype(np.int64)
                near = d <= radius
                out.append((query[near], node[near]))
                low = np.searchsorted(self.edges, node * WIDE + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edges, node * WIDE + d + radius, "right")
                many = high - low
                total = int(many.sum())
                ends = np.cumsum(many)
                edge = np.arange(total) - np.repeat(ends - many, many) + np.repeat(low, many)
                query = np.repeat(query, many)
                node = self.children[edge]
            if out:
                yield np.concatenate([q for q, _ in out]), np.concatenate([m for _, m in out])


class Sets:
    """Disjoint sets over 0..n-1, joined by whole arrays of pairs; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
