"""Prefix-tree join of ordered n-gram sets, inside one block of bounded size.

Sets are sequences of ranks in one global order (rare n-grams first). They are
stored in a path-compressed trie, so sets with equal beginnings share nodes. A
probe walks the trie once, carrying the overlap of the path so far; a subtree is
left when even its longest rest, or the rest of the probe, cannot reach the
overlap that the smallest set below would need.
"""

from __future__ import annotations

import numpy as np


class UnionFind:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


class _Node:
    __slots__ = ("children", "edge", "ends", "largest", "member", "rest", "smallest")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.ends = edge, {}, []
        self.smallest, self.largest, self.rest, self.member = 1 << 62, 0, 0, -1


class Trie:
    """``sizes`` are the sets' full sizes; the stored ranks may leave out n-grams that no other set has."""

    def __init__(self, sizes: list[int], groups: UnionFind):
        self.sizes, self.groups, self.root = sizes, groups, _Node(np.zeros(0, np.int64))

    def _pass(self, node: _Node, i: int, rest: int) -> None:
        size, find = self.sizes[i], self.groups.find
        if node.largest == 0:
            node.member = i
        elif node.member >= 0 and find(node.member) != find(i):
            node.member = -1  # more than one group below
        node.smallest, node.largest = min(node.smallest, size), max(node.largest, size)
        node.rest = max(node.rest, rest)

    def insert(self, i: int, ranks: np.ndarray) -> None:
        node, at = self.root, 0
        self._pass(node, i, len(ranks))
        while at < len(ranks):
            key = int(ranks[at])
            child = node.children.get(key)
            if child is None:
                child = node.children[key] = _Node(ranks[at:])
                self._pass(child, i, 0)
                child.ends.append(i)
                return
            m = min(len(child.edge), len(ranks) - at)
            differs = np.flatnonzero(child.edge[:m] != ranks[at : at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(child.edge):  # split the edge
                upper = _Node(child.edge[:same])
                upper.smallest, upper.largest, upper.member = child.smallest, child.largest, child.member
                upper.rest = child.rest + len(child.edge) - same
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[key] = child = upper
            at += same
            self._pass(child, i, len(ranks) - at)
            node = child
        node.ends.append(i)

    def probe(self, i: int, ranks: np.ndarray, held: np.ndarray) -> None:
        """Unite ``i`` with every group that holds a set of Jaccard similarity 0.8 or more.

        ``held`` is a scratch array of booleans over all ranks. Subtrees whose sets
        are all in the probe's group already are left out.
        """
        n, k, groups = self.sizes[i], len(ranks), self.groups
        held[ranks] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.member >= 0 and groups.find(node.member) == groups.find(i):
                continue
            if 5 * node.largest < 4 * n or 4 * node.smallest > 5 * n:
                continue
            left = k
            if len(node.edge):
                overlap += int(np.count_nonzero(held[node.edge]))
                left = k - int(np.searchsorted(ranks, node.edge[-1], side="right"))
            if 180 * (overlap + min(left, node.rest)) < 80 * (n + node.smallest):
                continue
            for j in node.ends:
                if 180 * overlap >= 80 * (n + self.sizes[j]):
                    groups.union(i, j)
            stack.extend((child, overlap) for child in node.children.values())
        held[ranks] = False


def link_sets(sizes: list[int], ranks: list[np.ndarray], universe: int, build: list[bool] | None = None) -> list[int]:
    """Group sets that are linked directly or through others of the block.

    With ``build`` only the marked sets are stored and only they are linked with
    the rest; otherwise every pair counts. Returns each set's smallest group member.
    """
    groups = UnionFind(len(sizes))
    trie = Trie(sizes, groups)
    held = np.zeros(universe, dtype=bool)
    order = sorted(range(len(sizes)), key=lambda i: (not build[i], sizes[i]) if build else sizes[i])
    for i in order:
        trie.probe(i, ranks[i], held)
        if build is None or build[i]:
            trie.insert(i, ranks[i])
    return [groups.find(i) for i in range(len(sizes))]
