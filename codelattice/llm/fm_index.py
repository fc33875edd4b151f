"""Compressed FM-index of one bounded sequence of symbols, searched for many patterns at once.

The transform is kept in a wavelet matrix: one plane of bits per bit of a symbol, with
counts of ones per 64 bits. Searches run backwards over all patterns together, and a
pattern stops as soon as nothing but its own place is left.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols at least, by doubling."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, size = np.argsort(rank, kind="stable"), 1
    while size < depth:
        pair = rank * (n + 1)
        pair[: n - size] += rank[size:] + 1
        order = np.argsort(pair, kind="stable")
        found = pair[order]
        new = np.append(0, np.cumsum(found[1:] != found[:-1]))
        rank[order] = new
        if new[-1] == n - 1:
            break
        size *= 2
    return order


class Wavelet:
    """Ranks over a sequence of non-negative symbols, in about bits * (1 + 1/2) bits a symbol."""

    def __init__(self, symbols: np.ndarray):
        self.n_bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for b in reversed(range(self.n_bits)):
            plane = (symbols >> b) & 1
            packed = np.packbits(np.append(plane, np.zeros(64 - len(plane) % 64, plane.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1].astype(np.int32))
            self.zeros.append(int(len(plane) - plane.sum()))
            symbols = np.concatenate([symbols[plane == 0], symbols[plane == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before `at`; start: place of the symbol's first one after the last level."""
        for level in range(self.n_bits):
            one = (symbol >> (self.n_bits - 1 - level)) & 1 == 1
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at - start[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, depth: int):
        """symbols: dense, non-negative. Patterns may have `depth` symbols at most."""
        suffixes = sorted_suffixes(symbols, depth)
        self.wavelet = Wavelet(symbols[suffixes - 1])
        counts = np.bincount(symbols, minlength=1)
        #: suffixes that start with a smaller symbol
        self.before = np.append(0, np.cumsum(counts))
        # in the wavelet matrix, symbols end up in order of their reversed bits
        n_bits = self.wavelet.n_bits
        back = np.zeros(len(counts), np.int64)
        for b in range(n_bits):
            back |= ((np.arange(len(counts)) >> b) & 1) << (n_bits - 1 - b)
        order = np.argsort(back)
        self.first = np.zeros(len(counts), np.int64)
        self.first[order] = np.append(0, np.cumsum(counts[order]))[:-1]

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the patterns that end (exclusively) at `ends` of symbols.

        Per pattern: how long a suffix of it, up to `length`, occurs twice at least, and
        where the interval of that suffix starts.
        """
        found, start = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        open_ = np.arange(len(ends))
        low = high = None
        for step in range(1, length + 1):
            c = symbols[ends[open_] - step]
            if low is None:
                low, high = self.before[c], self.before[c + 1]
            else:
                low, high = (self.before[c] + self.wavelet.rank(c, x, self.first) for x in (low, high))
            several = high - low > 1
            open_, low, high = open_[several], low[several], high[several]
            found[open_], start[open_] = step, low
            if not len(open_):
                break
        return found, start
