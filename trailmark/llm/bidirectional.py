"""A bidirectional FM-index over delimited words, and the search for words that differ by one edit.

The text is ``|w1|w2|...|wk|``. One index holds its suffixes, the other those of the reversed text; the interval
of a pattern is kept in both, so it can grow to either side. The search scheme matches the first half of a
word exactly, towards its opening delimiter, and then extends across the second half allowing one error.
"""

from __future__ import annotations

import numpy as np

from trailmark.llm.fm_index import WaveletMatrix, suffix_array

END, DELIMITER, LETTERS = 0, 1, 2


class OneSide:
    """Suffix ranks of a text that ends with ``END``, and the symbols before its suffixes."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.suffixes = suffix_array(text, depth)
        self.before = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of the pattern with a symbol in front, and how many suffixes are preceded by a smaller one."""
        smaller = np.zeros(len(low), np.int64)
        depth = self.before.depth
        for level, bits in enumerate(self.before.levels):
            one = (symbol >> (depth - 1 - level) & 1).astype(bool)
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            smaller += np.where(one, (high - ones_high) - (low - ones_low), 0)
            low = np.where(one, bits.zeros + ones_low, low - ones_low)
            high = np.where(one, bits.zeros + ones_high, high - ones_high)
        shift = self.first[symbol] - self.before.first[symbol]
        return low + shift, high + shift, smaller

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol before the suffixes of each interval: interval number, symbol, new interval."""
        owner, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for bits in self.before.levels:
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            low, high = np.concatenate([low - ones_low, bits.zeros + ones_low]), np.concatenate([high - ones_high, bits.zeros + ones_high])
            owner, symbol = np.concatenate([owner, owner]), np.concatenate([symbol << 1, symbol << 1 | 1])
            some = high > low
            owner, symbol, low, high = owner[some], symbol[some], low[some], high[some]
        shift = self.first[symbol] - self.before.first[symbol]
        return owner, symbol, low + shift, high + shift


class Words:
    """An index over distinct words, given as their code points in a row with n + 1 offsets."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        kinds, letters = np.unique(points, return_inverse=True)
        self.letters, self.offsets, self.n = letters + LETTERS, offsets, len(offsets) - 1
        text = np.full(len(points) + self.n + 2, DELIMITER, np.int64)
        text[-1] = END
        text[np.arange(len(points)) + np.repeat(np.arange(self.n), np.diff(offsets)) + 1] = self.letters
        backwards = np.append(text[-2::-1], END)
        sigma, depth = len(kinds) + LETTERS, int(np.diff(offsets).max(initial=0)) + 3
        self.forward, self.reverse = OneSide(text, sigma, depth), OneSide(backwards, sigma, depth)
        # The word after the delimiter at each place of the text.
        self.opened = np.cumsum(text == DELIMITER) - 1
        self.length = len(text) - 1

    def exact_halves(self, words: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval in the reverse index of the delimiter and the first ``halves`` letters of each word.

        The half is matched backwards from its last letter; the interval on the other side follows.
        """
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.length + 1)
        mirrored = low.copy()
        for step in range(1, int(halves.max(initial=0)) + 2):
            live = np.flatnonzero(step <= halves + 1)
            closing = step == halves[live] + 1
            at = self.offsets[words[live]] + halves[live] - step
            symbol = np.where(closing, DELIMITER, self.letters[np.where(closing, 0, at)])
            low[live], high[live], smaller = self.forward.extend(symbol, low[live], high[live])
            mirrored[live] += smaller
        return mirrored, mirrored + high - low

    def one_edit(self, words: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, number of the indexed word) that share the first half and differ by one edit after it.

        Two frontiers grow a letter at a time: patterns without an error yet, and patterns that have spent it.
        Now and then, spent patterns of one word that reached the same place and interval become one.
        """
        size, start = np.diff(self.offsets)[words], self.offsets[words]

        def due(query, at):
            ended = at == size[query]
            return ended, np.where(ended, DELIMITER, self.letters[np.where(ended, 0, start[query] + at)])

        low, high = self.exact_halves(words, halves)
        query, at = np.arange(len(words)), halves.copy()
        spent = np.empty((4, 0), np.int64)
        found, step = [np.empty((0, 2), np.int64)], 0
        while len(query) or spent.shape[1]:
            if spent.shape[1]:
                ended, symbol = due(spent[0], spent[1])
                spent_low, spent_high, _ = self.reverse.extend(symbol, spent[2], spent[3])
                some = spent_high > spent_low
                done = some & ended
                # The reversed text at this rank starts with the closing delimiter.
                place = self.length - 1 - self.reverse.suffixes[spent_low[done]]
                found.append(np.column_stack([spent[0][done], self.opened[place] - 1]))
                more = some & ~ended
                spent = np.stack([spent[0][more], spent[1][more] + 1, spent_low[more], spent_high[more]])
            if len(query):
                owner, symbol, child_low, child_high = self.reverse.children(low, high)
                letter = symbol >= LETTERS
                owner, symbol, child_low, child_high = owner[letter], symbol[letter], child_low[letter], child_high[letter]
                ended, next_one = due(query, at)
                replaced = ~ended[owner] & (symbol != next_one[owner])
                open_ = ~ended
                new = [
                    spent,
                    np.stack([query[owner], at[owner], child_low, child_high]),  # a letter more
                    np.stack([query[owner][replaced], at[owner][replaced] + 1, child_low[replaced], child_high[replaced]]),
                    np.stack([query[open_], at[open_] + 1, low[open_], high[open_]]),  # a letter less
                ]
                spent = np.concatenate(new, axis=1)
                step += 1
                if step % 8 == 0:
                    spent = spent[:, np.lexsort(spent)]
                    spent = spent[:, np.append(True, (np.diff(spent) != 0).any(axis=0))] if spent.shape[1] else spent
                query, at = query[open_], at[open_] + 1
                low, high, _ = self.reverse.extend(next_one[open_], low[open_], high[open_])
                some = high > low
                query, at, low, high = query[some], at[some], low[some], high[some]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]
