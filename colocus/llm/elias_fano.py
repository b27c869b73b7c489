"""Elias-Fano coded monotone sequences over a byte buffer, searched for many values at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_POP = np.array([bin(b).count("1") for b in range(256)], np.int64)
#: Place of the r-th set bit of a byte.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.int64)


def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each 64-bit word."""
    place, left, found = np.zeros(len(words), np.int64), r.copy(), np.zeros(len(words), bool)
    for k in range(8):
        byte = ((words >> U(8 * k)) & U(0xFF)).astype(np.int64)
        n = _POP[byte]
        here = ~found & (left < n)
        place[here] = 8 * k + _SELECT[byte[here], left[here]]
        found |= here
        left = np.where(found, left, left - n)
    return place


class EliasFano:
    """Non-decreasing whole numbers below 2**63: low bits packed, high bits in unary with a count before each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * low_bits >> 6) + 2, U)
        if low_bits:
            part = values.astype(U) & U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            shift = (at & 63).astype(U)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + low_bits > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (U(64) - shift[over]))
        place = (values >> low_bits) + np.arange(n)
        high = np.zeros((n + (top >> low_bits) + 2 >> 6) + 1, U)
        np.bitwise_or.at(high, place >> 6, U(1) << (place & 63).astype(U))
        count = np.bitwise_count(high).astype(np.int64)
        return cls(n, low_bits, low, high, (np.cumsum(count) - count).astype(np.uint32 if n < 2**32 else np.int64))

    def to_bytes(self) -> bytes:
        wide = self.ones.dtype.itemsize
        pad = b"\0" * (-len(self.ones) * wide % 8)
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), wide], np.int64)
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.ones.tobytes() + pad

    @classmethod
    def from_buffer(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence at a place of a buffer, without a copy, and the place after it."""
        n, low_bits, lows, highs, wide = (int(x) for x in np.frombuffer(buffer, np.int64, 5, at))
        at += 40
        low = np.frombuffer(buffer, U, lows, at)
        high = np.frombuffer(buffer, U, highs, at := at + 8 * lows)
        ones = np.frombuffer(buffer, np.uint32 if wide == 4 else np.int64, highs, at := at + 8 * highs)
        return cls(n, low_bits, low, high, ones), at + -(-highs * wide // 8) * 8

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U)
        first = self.low[word] >> shift
        second = (self.low[word + 1] << (U(63) - shift)) << U(1)
        return (first | second) & U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = (word << 6) + _in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self._low_at(i).astype(np.int64)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Place in the unary bits where the values with high bits h begin."""
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return np.where(h > 0, (word << 6) + _in_word(~self.high[word], k - self.zeros[word]) + 1, 0)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x, and whether it equals x: one jump to the bucket, then by halves of it, since buckets of clustered values are long."""
        top = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1])) - 1
        h = np.minimum(x >> self.low_bits, top)
        at, stop = self._bucket(h) - h, self._bucket(h + 1) - h - 1
        want = x.astype(U) & U((1 << self.low_bits) - 1)
        inside = x >> self.low_bits <= top
        high, live = stop.copy(), np.flatnonzero(inside & (at < stop))
        while len(live):
            mid = at[live] + high[live] >> 1
            less = self._low_at(mid) < want[live]
            at[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
            live = live[at[live] < high[live]]
        equal, left = np.zeros(len(x), bool), np.flatnonzero(inside & (at < stop))
        equal[left] = self._low_at(at[left]) == want[left]
        return np.where(inside, at, self.n), equal

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if none) for x of at least 0."""
        return self._search(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is absent."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        at, equal = self._search(x)
        return np.where(equal, at, -1)
