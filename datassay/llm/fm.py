"""A compressed full-text index of word numbers: Burrows-Wheeler transform in a wavelet tree, searched backward.

The tree is kept level by level (a wavelet matrix): a level is one bit a word, packed, with running counts of ones by
64-bit block, so a rank is a table entry and one population count. All searches go for many queries at once.
"""

from __future__ import annotations

import numpy as np

from .suffixes import suffix_array


class Bits:
    """A packed row of bits with rank."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, bool)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks))]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletTree:
    """Ranks of symbols in a sequence, log2(symbols) bits each."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.depth)):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place at the lowest level that stands for the place `at` of each symbol; ranks are differences of such places."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = level.ones(at)
            at = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + one, at - one)
        return at


class FmIndex:
    """Texts in one sequence of word numbers, 0 at each one's end.

    `first` answers where the earliest place of an interval of suffixes is: minima of places over powers of two.
    """

    def __init__(self, ids: np.ndarray):
        self.size = len(ids)
        order = suffix_array(ids)
        transform = ids[order - 1]  # the place before the first one is the last, a 0
        self.tree = WaveletTree(transform)
        counts = np.bincount(ids)
        symbols = np.arange(len(counts))
        # Where a symbol's suffixes begin, less where its descent from place 0 ends.
        self.base = np.cumsum(counts) - counts - self.tree.descend(symbols, np.zeros(len(counts), np.int64))
        self.lowest = [order.astype(np.int32)]
        while (step := 1 << (len(self.lowest) - 1)) * 2 <= self.size:
            last = self.lowest[-1]
            self.lowest.append(np.minimum(last[:-step], last[step:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with symbol and go on with those of [low, high): one step of the backward search."""
        n = len(symbol)
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.base[symbol] + both[:n], self.base[symbol] + both[n:]

    def first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place of each interval, none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.lowest[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out

    def count(self, pattern: list[int]) -> int:
        """How often a sequence of word numbers occurs."""
        low, high = np.zeros(1, np.int64), np.full(1, self.size)
        for s in reversed(pattern):
            if not 0 < s < len(self.base):
                return 0
            low, high = self.extend(np.array([s]), low, high)
        return max(0, int(high[0] - low[0]))

    def matches(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, earlier: bool = False) -> np.ndarray:
        """Matching statistics of streamed words: for each query, the length of the longest ids[e - m : e] within [begins, ends) that the index has, or 0 if that is under least.

        earlier: ids are the index's own words, and only what has a place before the stretch itself counts. Words that the
        index lacks match nothing.
        """
        m = np.zeros(len(ends), np.int64)
        live, depth = np.arange(len(ends)), 0
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        while len(live):
            place = ends[live] - depth - 1
            good = place >= begins[live]
            symbol = np.where(good, ids[place], 0)
            good &= (symbol > 0) & (symbol < len(self.base))
            live, low, high, symbol, place = (x[good] for x in (live, low, high, symbol, place))
            if not len(live):
                break
            low, high = self.extend(symbol, low, high)
            depth += 1
            # The stretch itself is in the interval where it is indexed, so there has to be one more.
            good = high - low > int(earlier)
            if earlier and depth >= least:
                at = np.flatnonzero(good)
                good[at] = self.first(low[at], high[at]) < place[at]
            live, low, high = live[good], low[good], high[good]
            if depth >= least:
                m[live] = depth
        return m
