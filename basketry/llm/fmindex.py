"""A compressed FM-index over sequences of small integers, in numpy.

The text is a run of segments of word numbers (1 and up), each closed by 0. The
Burrows-Wheeler transform is kept as a wavelet matrix: one bit vector per binary
digit of the symbols, packed 64 to a word with running counts, so a rank costs
two look-ups and a population count per digit. Searches run over many patterns at
once, one symbol per step from the right.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes; separators (0) sort before all words, and by place among themselves."""
    n = len(symbols)
    ends = symbols == 0
    keys = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    order = np.argsort(keys, kind="stable")
    rank, step = _ranks(keys[order], order), 1
    while step < n and rank[order[-1]] < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        keys = rank * (n + 1) + after
        order = np.argsort(keys, kind="stable")
        rank = _ranks(keys[order], order)
        step *= 2
    return order


def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(order), dtype=np.int64)
    rank[order[1:]] = np.cumsum(sorted_keys[1:] != sorted_keys[:-1])
    return rank


class WaveletMatrix:
    def __init__(self, values: np.ndarray):
        top = int(values.max(initial=0))
        self.depth = max(1, top.bit_length())
        self.levels = []
        for shift in range(self.depth - 1, -1, -1):
            bits = ((values >> shift) & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
            padded[: len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            running = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum(np.bitwise_count(packed), out=running[1:])
            self.levels.append((packed, running, int(len(bits) - bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])
        self.begin = self._down(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, running, zeros) in enumerate(self.levels):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            below = packed[word] & ((np.uint64(1) << bit) - np.uint64(1))
            ones = running[word] + np.bitwise_count(below)
            right = (symbols >> (self.depth - 1 - level)) & 1 == 1
            at = np.where(right, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, at) - self.begin[symbols]


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.order = suffix_array(symbols)
        self.wavelet = WaveletMatrix(symbols[self.order - 1])
        counts = np.bincount(symbols)
        self.first = np.cumsum(counts) - counts

    def search(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns ``symbols[start : start + length]``.

        A pattern that has become unique is left there: its range has size 1.
        """
        lo = np.zeros(len(starts), dtype=np.int64)
        hi = np.full(len(starts), len(self.symbols), dtype=np.int64)
        active = np.arange(len(starts))
        for step in range(length - 1, -1, -1):
            symbol = self.symbols[starts[active] + step]
            both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[active], hi[active]]))
            base = self.first[symbol]
            lo[active], hi[active] = base + both[: len(active)], base + both[len(active) :]
            active = active[hi[active] - lo[active] > 1]
            if not len(active):
                break
        return lo, hi


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of ``values[lo:hi]`` for many ranges, by tables over powers of two."""
    widths = hi - lo
    level = np.frexp(widths.astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k)])
        if (1 << (k + 1)) <= len(values):
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out
