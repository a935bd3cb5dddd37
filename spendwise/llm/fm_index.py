"""FM-index over a sequence of small integers, in numpy.

Rows are sorted by their first ``depth`` symbols (a bounded-context transform),
which is enough to search patterns of up to ``depth`` symbols.  The transformed
sequence is kept as a wavelet matrix: one packed bit vector per bit of the
alphabet, with a count per 64-bit word.  Rank, and with it backward search, is
vectorised over many patterns at once.  The sort passes through the grams of 2, 4,
8... symbols; the row intervals of the longest ones are kept, and the search of the
indexed text's own patterns starts from their last gram's interval.
"""
from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[:len(raw)] = raw
        self.words = packed.view("<u8").astype(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """``text``: symbols 0..sigma-1.  ``rows``: text positions in the sorted order
    (the caller may keep what it needs of them; the index does not)."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth, self.n = depth, n
        sigma = int(text.max()) + 1 if n else 1
        rows, self.gram, self.gram_at, self.starts = _sorted_rows(text, depth)
        self.text = text
        last = text[rows - 1]  # position -1: the text is read as a cycle
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.levels, self.zeros, self.bits = [], [], max(1, (sigma - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.levels.append(BitVector(bit))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.origin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))
        self.rows = rows

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, vector, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = vector.ones(i)
            i = np.where(c >> level & 1, zeros + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i of the transformed sequence."""
        return self._descend(c, i) - self.origin[c]

    def statistics(self, text: np.ndarray, ends: np.ndarray, limit: int, least: int = 1):
        """Backward search of the symbols up to ``ends`` (exclusive), leftwards, for as
        long as ``least`` rows or more match and at most ``limit`` symbols: the
        matched lengths and, for those that reach ``limit``, the row interval."""
        length = np.zeros(len(ends), np.int64)
        lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        known, gram = np.zeros(len(ends), bool), np.zeros(len(ends), np.int64)
        if text is self.text and self.gram <= min(limit, self.n):
            gram = self.gram_at[np.maximum(ends - self.gram, 0)]
            known = (ends >= self.gram) & (self.starts[gram + 1] - self.starts[gram] >= least)
        for alive, begin in ((np.flatnonzero(known), self.gram), (np.flatnonzero(~known), 0)):
            length[alive] = begin
            if begin:
                x, y = self.starts[gram[alive]], self.starts[gram[alive] + 1]
            else:
                x, y = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
            for step in range(begin + 1, limit + 1):
                if not len(alive):
                    break
                c = text[ends[alive] - step]
                x, y = self.first[c] + self.rank(c, x), self.first[c] + self.rank(c, y)
                on = y - x >= least
                alive, x, y = alive[on], x[on], y[on]
                length[alive] = step
            if limit and len(alive):
                lo[alive], hi[alive] = x, y
        return length, lo, hi


def _sorted_rows(text: np.ndarray, depth: int):
    """Positions of the (cyclic) text ordered by their next ``depth`` symbols, by
    doubling the compared length; the size of the longest grams of a whole doubling, the
    gram at each position, and the first row of each gram."""
    rank, done = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    gram, at = 1, rank
    while done < depth:
        step = min(done, depth - done)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if step == done:
            gram, at = 2 * done, rank
        done += step
    return np.argsort(rank, kind="stable"), gram, at, np.append(0, np.cumsum(np.bincount(at)))
