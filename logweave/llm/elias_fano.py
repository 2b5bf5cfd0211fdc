"""Elias-Fano code of a non-decreasing sequence, with select.

``n`` values up to ``u`` take about ``n * (2 + log2(u / n))`` bits: the low bits of each value are
stored as they are, the high bits as a bit vector in which value ``i`` sets bit ``(v >> low) + i``.
Select of value ``i`` finds the i-th set bit: the sampled position of every 256th one (32 bits each)
gives the byte to begin at, and popcounts of the bytes after it the rest.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<4sQQBQQQ")
_MAGIC = b"LWEF"
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """Encoded sequence; ``select(i)`` is its i-th value, ``values()`` all of them."""

    def __init__(self, n: int, last: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.last, self.low = n, last, low
        self.lows, self.highs, self.samples = lows, highs, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        last = int(v[-1]) if n else 0
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("the sequence must not decrease and not be negative")
        low = max(0, (last // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low)) & 1 if low else np.zeros((n, 0), np.int64)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> low) + np.arange(n)
        highs = np.zeros(int(ones[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(highs, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, last, low, lows, highs, ones[::STEP].astype(np.uint32))

    def _low(self, i: int) -> int:
        at, end = i * self.low, (i + 1) * self.low
        part = int.from_bytes(self.lows[at >> 3 : (end + 7) >> 3].tobytes(), "little")
        return part >> (at & 7) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // STEP])
        rest = i % STEP  # set bits to pass after the sampled one
        byte = at >> 3
        word = int(self.highs[byte]) >> (at & 7) << (at & 7)
        while (c := int(_ONES[word])) <= rest:
            rest -= c
            byte += 1
            word = int(self.highs[byte])
        for _ in range(rest):
            word &= word - 1
        one = (byte << 3) + (word & -word).bit_length() - 1
        return (one - i) << self.low | self._low(i)

    def values(self) -> np.ndarray:
        """All values, by one pass over both parts."""
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        high = ones - np.arange(self.n)
        if not self.low:
            return high
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return high << self.low | bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(_MAGIC, self.n, self.last, self.low, len(self.lows), len(self.highs), len(self.samples))
        return head + self.lows.tobytes() + self.highs.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, n, last, low, a, b, c = _HEAD.unpack_from(data)
        if magic != _MAGIC or len(data) != _HEAD.size + a + b + 4 * c:
            raise ValueError("not an Elias-Fano block")
        at = _HEAD.size
        lows = np.frombuffer(data, np.uint8, a, at)
        highs = np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, last, low, lows, highs, np.frombuffer(data, "<u4", c, at + a + b))
