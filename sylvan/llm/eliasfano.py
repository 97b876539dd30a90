"""Elias-Fano sequences in flat arrays, queried in bulk."""

from __future__ import annotations

import numpy as np

U1 = np.uint64(1)
#: Place of the k-th one in a byte.
IN_BYTE = np.array([([k for k in range(8) if v >> k & 1] + [0] * 8)[:8] for v in range(256)], np.int64)


def or_words(at: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """n words in which word ``at[i]`` (non-decreasing) holds ``bits[i]``."""
    out = np.zeros(n, np.uint64)
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[first]] = np.bitwise_or.reduceat(bits, first)
    return out


class EliasFano:
    """A non-decreasing sequence below ``universe``: ``width`` low bits packed, high parts in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        #: Ones and zeros before each word of the high parts.
        self.ones, self.zeros = ones, zeros

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << width) - 1)
        bit = np.arange(n, dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        size = (n * width >> 6) + 2
        packed = or_words(word, low << shift, size)
        over = np.flatnonzero((bit & 63) + width > 64)
        packed |= or_words(word[over] + 1, low[over] >> (np.uint64(64) - shift[over]), size)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = or_words(place >> 6, U1 << (place & 63).astype(np.uint64), ((int(universe) >> width) + n >> 6) + 2)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        kind = np.uint32 if len(high) < 1 << 25 else np.int64
        return cls(n, width, packed, high, ones.astype(kind), (np.arange(len(ones)) * 64 - ones).astype(kind))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def from_arrays(cls, head: np.ndarray, *arrays: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), *arrays)

    def select(self, rank: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the rank-th one (or zero) of the high parts."""
        word = np.searchsorted(counts, rank.astype(counts.dtype), "right") - 1
        left = rank - counts[word]
        bits = self.high[word]
        bits = ~bits if flip else bits
        place = word * 64
        for half in (32, 16, 8):
            n = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= n
            left = np.where(up, left - n, left)
            place = np.where(up, place + half, place)
            bits = np.where(up, bits >> np.uint64(half), bits)
        return place + IN_BYTE[(bits & np.uint64(255)).astype(np.int64), np.minimum(left, 7)]

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        more = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, U1)), np.uint64(0))
        return (self.low[word] >> shift | more) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self.select(i, self.ones, False) - i
        return (high.astype(np.uint64) << np.uint64(self.width) | self.lows(i)).astype(np.int64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """The first place of each value, -1 where it isn't in the sequence."""
        if not self.n:
            return np.full(len(value), -1)
        value = value.astype(np.uint64)
        high, low = (value >> np.uint64(self.width)).astype(np.int64), value & np.uint64((1 << self.width) - 1)
        out = np.full(len(value), -1)
        at = np.flatnonzero(high < self.zeros[-1])
        begin = np.zeros(len(at), np.int64)
        later = high[at] > 0
        begin[later] = self.select(high[at[later]] - 1, self.zeros, True) + 1
        some = self.high[begin >> 6] >> (begin & 63).astype(np.uint64) & U1 > 0  # else nothing has these high bits
        at, begin = at[some], begin[some] - high[at[some]]
        high, low = high[at], low[at]
        stop = self.select(high, self.zeros, True) - high
        lo, hi = begin, stop.copy()
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            less = self.lows(mid) < low[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
        hit = lo < stop
        at, lo, low = at[hit], lo[hit], low[hit]
        same = self.lows(lo) == low
        out[at[same]] = lo[same]
        return out
