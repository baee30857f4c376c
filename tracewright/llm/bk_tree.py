"""Trees whose children are keyed by integer Hamming distance to the parent (BK-trees), and labels of small graphs."""

from __future__ import annotations

import numpy as np


class Forest:
    """BK-trees over 64-bit integers, one for each run of equal groups; all of a level are built and searched at once.

    parent[x] is the value above x (-1 for the first of its group, the root) and edge[x] their distance. No two
    children of a value have the same edge. Equal values hang below each other at distance 0.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray) -> None:
        self.values = values.astype(np.uint64)
        n = len(values)
        first = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        down = np.flatnonzero(~first)
        at = self.root[down]
        while len(down):
            d = np.bitwise_count(self.values[down] ^ self.values[at]).astype(np.int64)
            key, where, back = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = down[where]  # the first of those that take the same edge
            self.parent[child], self.edge[child] = key // 65, key % 65
            below = child[back]
            more = below != down
            down, at = down[more], below[more]
        self.below = np.argsort(self.parent, kind="stable")
        self.start = np.searchsorted(self.parent[self.below], np.arange(n + 1))

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query index, value index) at most radius apart, each query in the tree of its root; only edges in [d - radius, d + radius] are followed."""
        queries = queries.astype(np.uint64)
        q, x = np.arange(len(queries)), roots.astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = [(q[:0], x[:0])]
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[x]).astype(np.int64)
            near = d <= radius
            found.append((q[near], x[near]))
            n = self.start[x + 1] - self.start[x]
            many = np.flatnonzero(n)
            n = n[many]
            up = np.repeat(many, n)
            child = self.below[np.repeat(self.start[x[many]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            follow = np.abs(self.edge[child] - d[up]) <= radius
            q, x = q[up[follow]], child[follow]
        return tuple(np.concatenate(p) for p in zip(*found, strict=True))


class Tree(Forest):
    """One BK-tree."""

    def __init__(self, values: np.ndarray) -> None:
        super().__init__(values, np.zeros(len(values), np.int64))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        return super().within(queries, np.zeros(len(queries) if len(self.values) else 0, np.int64), radius)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n points reaches over the pairs."""
    labels = np.arange(n)
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new
