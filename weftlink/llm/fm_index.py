"""A compressed FM-index over sequences of words, on a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np

_SIX, _LOW = 6, 63
_SUPER = 10  # a superblock is 1,024 words of 64 bits, so that counts within it fit 16 bits
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank of any symbol in any prefix, in 1.25 bits per symbol and level: 16 bits of count per 64, 64 per superblock."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.supers, self.zeros = [], [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            before = np.cumsum(ones) - ones
            self.bits.append(words)
            self.supers.append(before[:: 1 << _SUPER])
            self.counts.append((before - np.repeat(self.supers[-1], 1 << _SUPER)[: len(before)]).astype(np.uint16))
            self.zeros.append(self.n - int(ones.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.first = self._down(np.arange(sigma, dtype=np.int64), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (words, counts, supers, zeros) in enumerate(zip(self.bits, self.counts, self.supers, self.zeros, strict=True)):
            at = i >> _SIX
            ones = supers.take(at >> _SUPER) + counts.take(at) + np.bitwise_count(words.take(at) & _BELOW.take(i & _LOW))
            i = np.where((c >> (self.levels - 1 - k)) & 1, ones + zeros, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each ``c`` stands before place ``i``."""
        return self._down(c, i) - self.first[c]


def sorted_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Places of ``text`` in the order of the ``length`` or more symbols from there on (doubling; the text ends in low symbols)."""
    rank, k = text.astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        order = np.argsort(rank * (int(rank.max(initial=0)) + 2) + after, kind="stable")
        if k * 2 >= length:
            return order
        key = rank * (int(rank.max(initial=0)) + 2) + after
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank, k = new, k * 2


class FMIndex:
    """Finds runs of up to ``limit`` words in a collection of word sequences by backward search.

    ``sequences`` are numbered words, all 1 or more, concatenated; each ends in a 0, which no query matches. ``value`` is a
    number for each place, kept as its 32-bit rank; an interval's least value is reported with it.
    """

    def __init__(self, text: np.ndarray, sigma: int, value: np.ndarray, limit: int):
        self.limit = limit
        order = sorted_starts(text, limit)
        self.matrix = WaveletMatrix(text[order - 1].astype(np.int64), sigma)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.values, rank = np.unique(value, return_inverse=True)
        self.rank = np.concatenate([rank[order], [np.iinfo(np.int32).max]]).astype(np.int32)

    def matching_statistics(self, query: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place in ``ends``: the longest run of query words that ends there and is found (at most ``limit``), and its interval.

        Words outside the index are numbered 0. All places search at once, each a step back in the query at a time; a place
        leaves when its interval is empty.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.matrix.n)
        live = np.arange(len(ends))
        for step in range(self.limit):
            at = ends[live] - step
            live, at = live[at >= 0], at[at >= 0]
            c = query[at]
            live, c = live[c > 0], c[c > 0]
            if not len(live):
                break
            if step:
                both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]])) + np.concatenate([self.starts[c]] * 2)
                new_low, new_high = both[: len(c)], both[len(c) :]
            else:
                new_low, new_high = self.starts[c], self.starts[c + 1]
            found = new_high > new_low
            live = live[found]
            low[live], high[live] = new_low[found], new_high[found]
            length[live] += 1
        return length, low, high

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each interval; intervals are equal or disjoint, as those of runs of one length are."""
        if not len(low):
            return np.empty(0, np.int64)
        starts, first, back = np.unique(low, return_index=True, return_inverse=True)
        cuts = np.column_stack([starts, high[first]]).ravel()
        return self.values[np.minimum.reduceat(self.rank, cuts)[::2][back]]
