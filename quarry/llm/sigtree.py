"""Signature trees: exact set-similarity links within one block of sets.

Leaves hold up to LEAF sets, inner nodes up to FAN children. A node has the OR of its sets' token
bitmaps, their AND, and the range of their sizes. Two nodes are descended together only while the
largest overlap that any two of their sets can have may still reach what the smallest sizes need:

    overlap(a in M, b in N) <= max size of M - |bits in every set of M and in no set of N|

(and the same with M and N exchanged), since each such bit stands for a token of a that b lacks.
Node pairs whose sets all belong to one component are skipped too: a link there changes nothing.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 32, 4
WIDEST = 1 << 14


class Tree:
    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        words = bits // 64
        self.maps = np.zeros((len(sets), words), np.uint64)
        for i, s in enumerate(sets):
            at = np.unique(s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(self.maps[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.order = order
        self.nodes: list[tuple[int, int, list[int]]] = []  # from, to (places in order), children
        self.any, self.all, self.low, self.high = [], [], [], []
        level = [self._node(lo, min(lo + LEAF, len(order)), []) for lo in range(0, len(order), LEAF)]
        while len(level) > 1:
            level = [self._node(self.nodes[g[0]][0], self.nodes[g[-1]][1], g) for g in (level[i : i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0] if level else -1

    def _node(self, lo: int, hi: int, children: list[int]) -> int:
        own = self.order[lo:hi]
        self.nodes.append((lo, hi, children))
        self.any.append(np.bitwise_or.reduce(self.maps[own], axis=0))
        self.all.append(np.bitwise_and.reduce(self.maps[own], axis=0))
        self.low.append(int(self.sizes[own].min()))
        self.high.append(int(self.sizes[own].max()))
        return len(self.nodes) - 1


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def links(sets: list[np.ndarray], num: int, den: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join up exactly what all pairs with den * overlap >= num * union would join up.

    sets: sorted distinct 64-bit tokens, none empty. group: components known before, whose sets need
    no more links.
    """
    if len(sets) < 2:
        return []
    largest = max(len(s) for s in sets)
    bits = min(WIDEST, 1 << max(9, (4 * largest - 1).bit_length()))
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((np.array([s[0] for s in sets], np.uint64), (np.log(sizes) / -np.log(num / den)).astype(np.int64)))
    tree = Tree(sets, order, bits)
    root = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1].copy()
    found: list[tuple[int, int]] = []

    def need(total: np.ndarray | int):
        return -(-num * total // (num + den))

    def settled(x: tuple[int, int, list[int]], y: tuple[int, int, list[int]]) -> bool:
        r = root[order[x[0]]]
        return bool((root[order[x[0] : x[1]]] == r).all() and (root[order[y[0] : y[1]]] == r).all())

    stack = [(tree.root, tree.root)]
    while stack:
        m, n = stack.pop()
        x, y = tree.nodes[m], tree.nodes[n]
        if settled(x, y) and (m != n or not x[2] or root[order[x[0]]] == root[order[x[1] - 1]]):
            continue
        if m != n:
            if tree.high[m] * den < num * tree.low[n] or tree.high[n] * den < num * tree.low[m]:
                continue
            most = min(
                tree.high[m] - int(np.bitwise_count(tree.all[m] & ~tree.any[n]).sum()),
                tree.high[n] - int(np.bitwise_count(tree.all[n] & ~tree.any[m]).sum()),
            )
            if most < need(tree.low[m] + tree.low[n]):
                continue
        if x[2] or y[2]:
            left, right = x[2] or [m], y[2] or [n]
            pairs = [(a, b) for i, a in enumerate(left) for b in (right[i:] if m == n else right)]
            stack += sorted(pairs, key=lambda p: p[0] == p[1])  # a node with itself comes first
            continue
        a, b = order[x[0] : x[1]], order[y[0] : y[1]]
        lacks = np.bitwise_count(tree.maps[a][:, None, :] & ~tree.maps[b][None, :, :]).sum(-1, dtype=np.int64)
        misses = np.bitwise_count(~tree.maps[a][:, None, :] & tree.maps[b][None, :, :]).sum(-1, dtype=np.int64)
        least = need(sizes[a][:, None] + sizes[b][None, :])
        fits = (sizes[a][:, None] - lacks >= least) & (sizes[b][None, :] - misses >= least)
        if m == n:
            fits &= np.triu(np.ones(fits.shape, bool), 1)
        for i, j in np.argwhere(fits):
            p, q = int(a[i]), int(b[j])
            if root[p] == root[q]:
                continue
            both = common(sets[p], sets[q])
            if den * both >= num * (len(sets[p]) + len(sets[q]) - both):
                found.append((p, q))
                root[root == root[q]] = root[p]
    return found
