"""A compressed full-text index over integer symbols: wavelet matrix and backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = self.n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Counts of a symbol in any prefix, with one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        zero = np.zeros(sigma, np.int64)
        self.first = self._descend(zero, np.arange(sigma))

    def _descend(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.depth - 1 - level) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often the symbol occurs among the first i."""
        return self._descend(i, symbol) - self.first[symbol]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` symbols from each, by prefix doubling."""
    n, done = len(text), 1
    rank = text.astype(np.int64)
    while True:
        # The end of the text sorts before every symbol.
        following = np.zeros(n, np.int64)
        following[: n - done] = rank[done:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        done *= 2
        if done >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value in each range, from the minima of ranges of each power of two in turn."""
    power = np.floor(np.log2(np.maximum(high - low, 1))).astype(np.int8)
    out = np.empty(len(low), values.dtype)
    for p in range(int(power.max(initial=-1)) + 1):
        if p:
            half = 1 << (p - 1)
            values = np.minimum(values[:-half], values[half:])
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(values[low[at]], values[high[at] - (1 << p)])
    return out


class FMIndex:
    """Index of a text whose symbols are 0 (a separator) to sigma - 1, for patterns up to ``depth``."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.suffixes = suffix_array(text, depth)
        self.last = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of a pattern with one more symbol in front."""
        both = self.last.rank(np.concatenate([low, high]), np.concatenate([symbol, symbol]))
        return self.below[symbol] + both[: len(low)], self.below[symbol] + both[len(low) :]

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and suffix range of the longest match that ends before each of ``ends``, streamed
        backwards, up to ``longest`` symbols. A match must occur twice: the streamed text is indexed
        itself, so one occurrence is its own."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.below[-1])
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(1, longest + 1):
            new_low, new_high = self.extend(text[ends[live] - step], low[live], high[live])
            more = new_high - new_low > 1
            live = live[more]
            if not len(live):
                break
            low[live], high[live] = new_low[more], new_high[more]
            length[live] = step
        return length, low, high
