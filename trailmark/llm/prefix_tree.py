"""A trie of ordered sets, walked to find the sets that overlap enough."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    """A path of elements that some sets share, and what lies below it.

    ``first`` to ``end`` are the sets below in sorted order; ``least`` is the size of the smallest,
    ``rest`` the most elements that any has after this path.
    """

    __slots__ = ("path", "first", "end", "children", "ending", "least", "rest")


def build(sets: Sequence[np.ndarray], sizes: np.ndarray) -> Node:
    """Trie of sets that are sorted by their elements, one node for each shared path."""
    n = len(sets)
    common = np.zeros(n + 1, np.int64)
    for i in range(1, n):
        m = min(len(sets[i - 1]), len(sets[i]))
        differ = np.flatnonzero(sets[i - 1][:m] != sets[i][:m])
        common[i] = differ[0] if len(differ) else m

    def make(first: int, end: int, depth: int) -> tuple[Node, int]:
        node = Node()
        to = len(sets[first]) if end - first == 1 else int(min(common[first + 1 : end].min(), len(sets[first])))
        node.path, node.first, node.end = sets[first][depth:to], first, end
        node.least = int(sizes[first:end].min())
        node.rest = max(len(s) for s in sets[first:end]) - to
        node.children, node.ending = [], []
        return node, to

    root, to = make(0, n, 0)
    stack = [(root, to)]
    while stack:
        node, depth = stack.pop()
        i = node.first
        while i < node.end:
            j = i + 1
            if len(sets[i]) == depth:
                node.ending.append(i)
            else:
                while j < node.end and common[j] > depth:
                    j += 1
                child, to = make(i, j, depth)
                node.children.append(child)
                stack.append((child, to))
            i = j
    return root


def links(
    sets: Sequence[np.ndarray], sizes: np.ndarray, enough: tuple[int, int], labels: Sequence[int], may_meet: Callable[[int, int], bool] = lambda i, j: True
) -> UnionFind:
    """Components of the sets in which den * |x & y| >= num * |x | y|, with (num, den) = ``enough``.

    ``sets`` hold the elements of each set that others have too, ascending; ``sizes`` count all elements.
    Sets of equal ``labels`` are known to be connected. Each set in turn walks the trie: the overlap
    with a shared path is counted once for all sets below, and a subtree is left when even all elements
    to come would not be enough, or when its sets are connected to the walker already.
    """
    num, den = enough
    order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
    ordered, sized = [sets[i] for i in order], np.asarray(sizes)[order]
    joined = UnionFind(len(sets))
    known: dict[int, int] = {}
    for place, i in enumerate(order):
        joined.union(place, known.setdefault(labels[i], place))
    root = build(ordered, sized)
    width = 1 + max((int(s[-1]) for s in ordered if len(s)), default=0)
    roots = np.array([joined.find(i) for i in range(len(order))])
    change = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    for place, mine in enumerate(ordered):
        has = np.zeros(width, bool)
        has[mine] = True
        size, dirty = int(sized[place]), False
        stack = [(root, 0, 0)]
        while stack:
            node, overlap, seen = stack.pop()
            if node.end <= place + 1:
                continue
            if change[node.first] == change[node.end - 1] and roots[node.first] == roots[place]:
                continue
            if len(node.path):
                overlap += int(np.count_nonzero(has[node.path]))
                seen = int(np.searchsorted(mine, node.path[-1], side="right"))
            most = overlap + min(node.rest, len(mine) - seen)
            if (num + den) * most < num * (size + node.least):
                continue
            for other in node.ending:
                fits = (num + den) * overlap >= num * (size + int(sized[other]))
                if other > place and fits and may_meet(order[place], order[other]) and joined.find(other) != joined.find(place):
                    joined.union(other, place)
                    dirty = True
            stack.extend((child, overlap, seen) for child in node.children)
        if dirty:
            roots = np.array([joined.find(i) for i in range(len(order))])
            change = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
    out = UnionFind(len(sets))
    for place, i in enumerate(order):
        out.union(i, order[joined.find(place)])
    return out
