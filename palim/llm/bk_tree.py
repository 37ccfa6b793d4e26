"""Forests of BK-trees over 64-bit fingerprints, built and searched level by level with arrays."""

from __future__ import annotations

import numpy as np


class Forest:
    """One tree for each group of distinct fingerprints; children are keyed by their integer Hamming distance to the parent.

    Node i is element order[i]; the children of a node are consecutive in `child`, ascending by `edge`.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        """prints with equal `group` (integers from 0, ascending) form a tree; its root is the first of them."""
        self.prints = prints
        n = len(prints)
        parent = np.full(n, -1, np.int64)
        edge = np.zeros(n, np.int64)
        rest = np.arange(n)
        key = group.astype(np.int64)  # elements with one key still compete for one place
        above = np.full(n, -1, np.int64)
        distance = np.zeros(n, np.int64)
        self.roots = np.full(int(group.max()) + 1 if n else 0, -1, np.int64)
        top = True
        while len(rest):
            first = np.concatenate(([True], key[1:] != key[:-1]))
            head = np.flatnonzero(first)
            node = rest[head]
            parent[node], edge[node] = above[head], distance[head]
            if top:
                self.roots[group[node]] = node
                top = False
            owner = node[np.cumsum(first) - 1]
            stay = ~first
            rest, owner = rest[stay], owner[stay]
            distance = np.bitwise_count(prints[rest] ^ prints[owner]).astype(np.int64)
            order = np.argsort(owner * 65 + distance, kind="stable")
            rest, owner, distance = rest[order], owner[order], distance[order]
            key, above = owner * 65 + distance, owner
        inner = np.flatnonzero(parent >= 0)
        inner = inner[np.argsort(parent[inner] * 65 + edge[inner], kind="stable")]
        self.child = inner
        self.code = parent[inner] * 65 + edge[inner]

    def within(self, query: np.ndarray, group: np.ndarray, radius: int, step: int = 1 << 18):
        """Yields (query index, element) for all elements of the query's group within the radius; step bounds what is looked at at once."""
        start = np.arange(0, len(query), step)
        todo = [(np.arange(i, min(i + step, len(query))), None, None) for i in start]
        while todo:
            q, a, size = todo.pop()
            if a is None:
                node = self.roots[group[q]]
            else:
                ends = np.cumsum(size)
                if ends[-1] > step and len(q) > 1:  # ranges of children are split before they are unrolled
                    i = max(1, int(np.searchsorted(ends, step, "right")))
                    todo += [(q[i:], a[i:], size[i:]), (q[:i], a[:i], size[:i])]
                    continue
                node = self.child[np.repeat(a - np.concatenate(([0], ends[:-1])), size) + np.arange(ends[-1])]
                q = np.repeat(q, size)
            d = np.bitwise_count(query[q] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            a = np.searchsorted(self.code, node * 65 + np.maximum(d - radius, 0))
            b = np.searchsorted(self.code, node * 65 + np.minimum(d + radius, 64), "right")
            size = b - a
            some = size > 0
            a, size, q = a[some], size[some], q[some]
            if len(q):
                todo.append((q, a, size))
