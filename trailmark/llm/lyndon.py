"""Runs of integer texts: Lyndon arrays by grouping of suffixes, and Lyndon roots extended by common extensions.

A run is a stretch with smallest period p, twice p long or more, that cannot be extended. Each run has a place
where its root is the longest Lyndon word starting there, under the order of the symbols or the reverse one.
"""

from __future__ import annotations

import numpy as np


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position.

    Symbol 0 separates texts, and the first symbol must be one; it is smaller than all others, so no word
    contains it. Suffixes are grouped by the first phase of a two-phase suffix sorter. Groups are ordered, and all
    suffixes of a group start with the same word, its context. From the highest group down, the places
    before the members that belong to lower groups grow by the contexts that follow them, and move to a new group
    just above their own. When a group's turn comes its context is the longest Lyndon word of its members. Each position is
    taken once, so time and memory are linear.
    """
    n = len(symbols)
    kinds, first = np.unique(symbols, return_inverse=True)
    order = np.argsort(first, kind="stable")
    members = [m.tolist() for m in np.split(order, np.cumsum(np.bincount(first))[:-1])]
    group = first.tolist()
    length = [1] * len(kinds)
    lower, upper = list(range(-1, len(kinds) - 1)), list(range(1, len(kinds) + 1))
    # Positions of groups whose turn has not come, linked in text order.
    left, right = list(range(-1, n - 1)), list(range(1, n + 2))
    left.append(n - 1)
    out = [1] * n
    at = len(kinds) - 1
    while at > 0:
        size, places, counts, last = length[at], [], [], -1
        for s in members[at]:
            if group[s] != at:
                continue
            out[s] = size
            before, after = left[s], right[s]
            right[before] = after
            left[after] = before
            if before == last:
                counts[-1] += 1
            else:
                places.append(before)
                counts.append(1)
                last = before
        members[at] = None
        moved = {}
        for p, c in zip(places, counts):
            if group[p]:
                moved.setdefault((c, group[p]), []).append(p)
        # Most contexts first, so they end up highest above their old group.
        for c, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, above = len(members), upper[old]
            found = moved[c, old]
            members.append(found)
            length.append(length[old] + c * size)
            lower.append(old)
            upper.append(above)
            lower[above] = upper[old] = new
            for p in found:
                group[p] = new
        at = lower[at]
    return np.array(out, np.int64)


class Extensions:
    """Longest common extensions to both sides, from names of the stretches of each power of two."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.names = [symbols]
        step = 1
        while 2 * step <= longest:
            last = self.names[-1]
            pairs = last[:-step] * (int(last.max(initial=0)) + 1) + last[step:]
            self.names.append(np.unique(pairs, return_inverse=True)[1])
            step *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols from a and b on."""
        done = np.zeros(len(a), np.int64)
        for power in range(len(self.names) - 1, -1, -1):
            name = self.names[power]
            # A step can repeat only at the top.
            while True:
                i, j = a + done, b + done
                inside = np.flatnonzero(np.maximum(i, j) < len(name))
                same = inside[name[i[inside]] == name[j[inside]]]
                done[same] += 1 << power
                if power < len(self.names) - 1 or not len(same):
                    break
        return done

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols before a and b."""
        done = np.zeros(len(a), np.int64)
        for power in range(len(self.names) - 1, -1, -1):
            name, step = self.names[power], 1 << power
            while True:
                i, j = a - done - step, b - done - step
                inside = np.flatnonzero((np.minimum(i, j) >= 0) & (np.maximum(i, j) < len(name)))
                same = inside[name[i[inside]] == name[j[inside]]]
                done[same] += step
                if power < len(self.names) - 1 or not len(same):
                    break
        return done


def runs(texts: list[np.ndarray], least: int, times: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs with length >= max(least, times * period), in order.

    ``times`` is 2 at least. The symbols are integers from 0 on, and texts are searched together.
    """
    if not texts:
        return np.empty((0, 4), np.int64)
    lengths = np.array([len(t) for t in texts])
    at = np.cumsum(lengths + 1) - lengths  # each text follows its separator
    joined = np.zeros(int(at[-1] + lengths[-1]) + 1, np.int64)
    inside = np.ones(len(joined), bool)
    inside[np.append(at - 1, len(joined) - 1)] = False
    _, symbols = np.unique(np.concatenate(texts), return_inverse=True)
    joined[inside] = symbols + 1
    separators = np.flatnonzero(~inside)
    named = joined.copy()
    named[separators] = np.arange(len(separators)) + len(symbols) + 1  # each differs from all others
    extend = Extensions(named, int(lengths.max()))
    top = int(joined.max())
    found = []
    for ordered in (joined, np.where(inside, top + 1 - joined, 0)):
        places = np.flatnonzero(inside)
        period = lyndon_array(ordered)[places]
        start = places - extend.left(places, places + period)
        end = places + period + extend.right(places, places + period)
        kept = end - start >= np.maximum(least, times * period)
        found.append(np.stack([start, end - start, period], 1)[kept])
    rows = np.unique(np.concatenate(found), axis=0)
    text = np.searchsorted(at, rows[:, 0], side="right") - 1
    return np.column_stack([text, rows[:, 0] - at[text], rows[:, 1:]])
