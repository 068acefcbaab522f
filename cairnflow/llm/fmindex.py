"""An FM-index over integer symbols: suffix order, wavelet-matrix ranks, sampled suffix positions.

Everything works on whole arrays of patterns at once, so that the index of a training shard answers thousands of
phrases with a few dozen numpy calls.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of symbols, where each 0 is a separator that differs from all others (prefix doubling).

    Only suffixes that are still tied are sorted again; ties end at the next separator at the latest.
    """
    n = len(symbols)
    zeros = symbols == 0
    rank = symbols.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    k, tied = 1, _tied(rank, order)
    while len(tied):
        at = order[tied]
        ahead = at + k
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[tied] = at = at[by]
        key = key[by]
        first = np.r_[True, key[1:] != key[:-1]]
        rank[at] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        tied = tied[_tied_keys(first)]
        k *= 2
    return order


def _ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each suffix: the place of the first in its group of equals."""
    place = np.arange(len(values))
    first = np.r_[True, values[1:] != values[:-1]] if len(values) else np.zeros(0, bool)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0)) if len(values) else place
    return rank


def _tied_keys(first: np.ndarray) -> np.ndarray:
    alone = first & np.r_[first[1:], True]
    return ~alone


def _tied(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places in the order whose suffix shares its rank with another."""
    r = rank[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    return np.flatnonzero(_tied_keys(first)) if len(r) else np.zeros(0, np.int64)


class BitRanks:
    """Bits packed in 64-bit words with a running count for each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in front of place i."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """A level for each bit of the symbols, highest first; each level keeps the zeros in front of the ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        s = symbols
        for b in range(bits - 1, -1, -1):
            one = (s >> b) & 1 != 0
            self.levels.append(BitRanks(one))
            self.zeros.append(len(s) - int(one.sum()))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that symbol occurs in front of place i."""
        start = np.zeros_like(i)
        for level, zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> b) & 1 != 0
            s1, i1 = level.rank1(start), level.rank1(i)
            start = np.where(one, zeros + s1, start - s1)
            i = np.where(one, zeros + i1, i - i1)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        out = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(i)
            r = level.rank1(i)
            out = (out << 1) | one
            i = np.where(one, zeros + r, i - r)
        return out


class FMIndex:
    """symbols: int array with 0 as separator, 0 first; sigma: all symbols are below it."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        self.n = len(symbols)
        order = suffix_order(symbols)
        last = symbols[order - 1]  # the symbol in front of each suffix; the text is a ring
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.starts = np.r_[0, np.cumsum(counts)]
        self.ranks = WaveletMatrix(last.astype(np.int64), max(1, int(sigma).bit_length()))
        # A walk to the left ends at a sampled position, at the latest behind a separator.
        sampled = (order % sample == 0) | (last == 0)
        self.sampled = BitRanks(sampled)
        self.positions = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the row range of each pattern (row of `patterns`, left-aligned, of so many symbols)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, (int(lengths.max()) if len(lengths) else 0) + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - step]
            low[live] = self.starts[c] + self.ranks.rank(c, low[live])
            high[live] = self.starts[c] + self.ranks.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to the left until a sampled suffix, then add the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            open_ = open_[~self.sampled.get(rows[open_])]
            r = rows[open_]
            c = self.ranks.access(r)
            rows[open_] = self.starts[c] + self.ranks.rank(c, r)
            steps[open_] += 1
        return self.positions[self.sampled.rank1(rows)] + steps
