"""Elias-Fano lists: non-decreasing integers in near-minimal space.

A value is split at ``low`` bits, log2 of the mean gap. The low parts are packed
as they are; the high parts are a bit string in which value k, whose high part
is h, sets bit h + k. A list of n values below u takes n (2 + log2(u / n)) bits.
The bit positions of every ``SAMPLE``-th value are kept, so value k is found by
a select that starts at the nearest sample, without a table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBI")  # values, largest value, low bits, samples
SAMPLE = 256
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class EliasFano:
    """A list read from its bytes; nothing is unpacked until it is asked for."""

    def __init__(self, packed: bytes | memoryview) -> None:
        self.n, self.most, self.low, samples = _HEAD.unpack_from(packed)
        at = _HEAD.size
        self.samples = np.frombuffer(packed, "<u4", samples, at)
        at += 4 * samples
        bytes_low = (self.n * self.low + 7) // 8
        self.lows = np.frombuffer(packed, np.uint8, bytes_low, at)
        self.highs = np.frombuffer(packed, np.uint8, -1 if len(packed) > at + bytes_low else 0, at + bytes_low)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        """``values``: non-decreasing, unsigned 64-bit."""
        values = values.astype(np.uint64, copy=False)
        n = len(values)
        most = int(values[-1]) if n else 0
        low = max(0, (most // n).bit_length() - 1) if n else 0
        place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        length = int(place[-1]) + 1 if n else 0
        if length >> 32:
            raise ValueError("too many values for one list")
        high = np.zeros(length, np.uint8)
        high[place] = 1
        bits = np.zeros((n, low), np.uint8)
        for b in range(low):
            bits[:, b] = (values >> np.uint64(b)).astype(np.uint8) & 1
        samples = place[::SAMPLE].astype("<u4")
        return _HEAD.pack(n, most, low, len(samples)) + samples.tobytes() + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()

    def __len__(self) -> int:
        return self.n

    def select(self, k: int) -> int:
        """Bit position of the k-th set bit of the high parts."""
        at = int(self.samples[k // SAMPLE])
        left = k % SAMPLE
        byte = at // 8
        first = int(self.highs[byte]) >> (at % 8) << (at % 8)
        # Bytes are counted in blocks until the block that holds the bit.
        while True:
            block = self.highs[byte : byte + 64].copy()
            block[0] = first
            seen = np.cumsum(_ONES[block])
            if left < seen[-1]:
                here = int(np.searchsorted(seen, left, side="right"))
                inside = left - (int(seen[here - 1]) if here else 0)
                return 8 * (byte + here) + int(np.flatnonzero(np.unpackbits(block[here : here + 1], bitorder="little"))[inside])
            left -= int(seen[-1])
            byte += 64
            first = int(self.highs[byte])

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        value = (self.select(k) - k) << self.low
        if self.low:
            start = k * self.low
            chunk = int.from_bytes(self.lows[start // 8 : (start + self.low + 7) // 8].tobytes(), "little")
            value |= (chunk >> (start % 8)) & ((1 << self.low) - 1)
        return value

    def values(self) -> np.ndarray:
        """All values."""
        place = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))
        out = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            for b in range(self.low):
                out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out
