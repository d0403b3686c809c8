"""Elias-Fano code of a rising list of integers, with a select structure.

``n`` values up to ``universe`` take about 2 + log2(universe / n) bits each: the low bits side by side, the high
bits in unary in one bit array. The k-th value is found by selecting the k-th set bit there: the place
of every 256th set bit (32 bits each) is where to start, and words are counted from there on.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 256


class EliasFano:
    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.high, self.samples = n, universe, low, high, samples
        self.bits = low_bits(n, universe)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        bits = low_bits(n, universe)
        low = np.empty(0, np.uint8)
        if bits and n:
            planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = (int(ones[-1]) >> 6) + 1 if n else 0
        flags = np.zeros(64 * words, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view("<u8") if words else np.empty(0, "<u8")
        return cls(n, universe, low, high, ones[::SAMPLE].astype("<u4"))

    def __getitem__(self, k: int) -> int:
        """The k-th value, by select."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        word = at >> 6
        here = int(self.high[word]) >> (at & 63) << (at & 63)  # from the sampled bit on
        while here.bit_count() <= left:
            left, word = left - here.bit_count(), word + 1
            here = int(self.high[word])
        for _ in range(left):
            here &= here - 1
        place = 64 * word + (here & -here).bit_length() - 1
        return ((place - k) << self.bits) | self._low(k)

    def _low(self, k: int) -> int:
        value = 0
        for j in range(self.bits):
            at = k * self.bits + j
            value |= ((int(self.low[at >> 3]) >> (at & 7)) & 1) << j
        return value

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        if not self.n:
            return np.empty(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)) << self.bits
        if self.bits:
            flags = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.int64)
            values |= (flags << np.arange(self.bits)).sum(1)
        return values


def low_bits(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0
