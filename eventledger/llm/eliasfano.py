"""Elias-Fano sequences: n non-decreasing numbers up to u in about n * (2 + log2(u / n)) bits, with select.

Low bits are packed one after another; high parts are in unary, as set bits. A directory counts the set bits before each
BLOCK bits in 32 bits each, an eighth of the high part or less, so a select looks into one block only.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 256
#: Numbers that one pass selects at most; bounds its memory.
AT_ONCE = 1 << 14


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.before = n, low_bits, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: whole numbers from 0 to 2**64 - 1."""
        x = np.asarray(values)
        if len(x) and x.dtype.kind == "i" and x[0] < 0:
            raise ValueError("values must not be negative")
        x = x.astype(np.uint64)
        n = len(x)
        if (x[1:] < x[:-1]).any():
            raise ValueError("values must be non-decreasing")
        top = int(x[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        planes = ((x[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(ones[-1]) + 1) // BLOCK) * BLOCK if n else 0, dtype=np.uint8)
        bits[ones] = 1
        before = np.searchsorted(ones, np.arange(0, len(bits), BLOCK)).astype("<u4")
        return cls(n, low_bits, np.packbits(planes.ravel()), np.packbits(bits), before)

    def select(self, places: np.ndarray) -> np.ndarray:
        """The numbers at places, as uint64."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not 0 <= places.min() <= places.max() < self.n:
            raise IndexError("no such place")
        parts = [self._select(places[i : i + AT_ONCE]) for i in range(0, len(places), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def _select(self, places: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.before, places, side="right") - 1
        blocks, row = np.unique(block, return_inverse=True)
        bits = np.unpackbits(self.high.reshape(-1, BLOCK // 8)[blocks], axis=1)
        ones = np.flatnonzero(bits)  # by block, then by place
        held = bits.sum(axis=1, dtype=np.int64)
        first = np.cumsum(held) - held
        one = ones[first[row] + places - self.before[block]]
        at = block * BLOCK + one % BLOCK
        return ((at - places).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(places)

    def _low(self, places: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(places), dtype=np.uint64)
        bit = places[:, None] * self.low_bits + np.arange(self.low_bits)
        values = (self.low[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
        return values.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.before.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """(the sequence that begins at a byte, the byte after it)."""
        n, low_bits, low, high = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (high * 8 // BLOCK, np.dtype("<u4"))):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(n, low_bits, *parts), at
