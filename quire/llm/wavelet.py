"""A wavelet matrix: a sequence of integers as bit planes.

Plane k holds bit ``bits-1-k`` of every value, in the order that the planes
above leave: values with bit 0 move to the front, stably. Beside each plane
stand the ones before each block of 512 bits (rank). A value is read, its
occurrences counted and found by following positions through the planes, many
positions at once."""

from __future__ import annotations

import numpy as np

BLOCK = 512
_WORDS = BLOCK // 64
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


class WaveletMatrix:
    def __init__(self, planes: list[np.ndarray], ranks: list[np.ndarray], n: int):
        """``planes``: little-endian 64-bit words, a whole number of blocks, zero
        behind the n-th bit. ``ranks``: 32-bit ones before each block, and in all."""
        self.planes, self.ranks, self.n, self.bits = planes, ranks, n, len(planes)
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, values: np.ndarray) -> "WaveletMatrix":
        n = len(values)
        bits = max(1, int(values.max()).bit_length()) if n else 1
        row = values.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ranks = [], []
        for k in range(bits - 1, -1, -1):
            one = (row & row.dtype.type(1 << k)) != 0
            packed = np.packbits(one, bitorder="little")
            words = np.pad(packed, (0, -len(packed) % (BLOCK // 8))).view("<u8")
            planes.append(words)
            counts = np.bitwise_count(words).reshape(-1, _WORDS).sum(1, dtype=np.int32)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<i4"))
            row = np.concatenate((row[~one], row[one]))
        return cls(planes, ranks, n)

    def to_parts(self) -> tuple[list[bytes], list[bytes]]:
        return [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks]

    @classmethod
    def from_parts(cls, planes: list[bytes], ranks: list[bytes], n: int) -> "WaveletMatrix":
        return cls([np.frombuffer(p, "<u8") for p in planes], [np.frombuffer(r, "<i4") for r in ranks], n)

    def _rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane k before each i: from the table, and of the block's words."""
        block, words = i // BLOCK, self.planes[k]
        out = self.ranks[k][block].astype(np.int64)
        left = i - block * BLOCK
        for w in range(_WORDS):
            upto = np.clip(left - 64 * w, 0, 64).astype(np.uint64)
            some = upto > 0
            if not some.any():
                break
            word = words[np.minimum(block * _WORDS + w, max(len(words) - 1, 0))]
            mask = np.where(some, _ALL >> (np.uint64(64) - np.maximum(upto, _ONE)), np.uint64(0))
            out += np.bitwise_count(word & mask)
        return out

    def access(self, i: np.ndarray | int) -> np.ndarray:
        """The values at i."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("position outside the sequence")
        value = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit = (self.planes[k][i // 64] >> (i % 64).astype(np.uint64) & _ONE).astype(bool) if len(i) else np.zeros(0, bool)
            one = self._rank1(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            value = value << 1 | bit
        return value

    def _range(self, value: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, behind the last plane, the occurrences of each value before i lie."""
        lo, hi = np.zeros(len(value), np.int64), np.where(value >> self.bits == 0, i, 0)
        for k in range(self.bits):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            one = (value >> (self.bits - 1 - k) & 1).astype(bool)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return lo, np.maximum(hi, lo)

    def rank(self, value: np.ndarray | int, i: np.ndarray | int) -> np.ndarray:
        """Occurrences of each value before i."""
        value, i = np.broadcast_arrays(np.atleast_1d(np.asarray(value, np.int64)), np.asarray(i, np.int64))
        lo, hi = self._range(value, i)
        return np.where(value >> self.bits == 0, hi - lo, 0)

    def count(self, value: np.ndarray | int) -> np.ndarray:
        return self.rank(value, self.n)

    def _select(self, k: int, bit: bool, j: np.ndarray) -> np.ndarray:
        """Positions of the j-th (from 0) such bits of plane k, j rising."""
        ranks = self.ranks[k].astype(np.int64)
        before = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = np.searchsorted(before, j, side="right") - 1
        out = np.empty(len(j), np.int64)
        for b in np.unique(block).tolist():
            bits = np.unpackbits(self.planes[k][b * _WORDS : (b + 1) * _WORDS].view(np.uint8), bitorder="little")[: self.n - b * BLOCK]
            at = block == b if len(j) > 1 else slice(None)
            out[at] = b * BLOCK + np.flatnonzero(bits == bit)[j[at] - before[b]]
        return out

    def select(self, value: int, j: np.ndarray | int) -> np.ndarray:
        """Positions of the j-th (from 0) occurrences of a value, j rising."""
        j = np.atleast_1d(np.asarray(j, np.int64))
        lo, hi = (int(x[0]) for x in self._range(np.array([value]), np.array([self.n])))
        count = hi - lo if value >> self.bits == 0 else 0
        if len(j) and not (0 <= j.min() and j.max() < count):
            raise IndexError("no such occurrence")
        i = lo + j
        for k in range(self.bits - 1, -1, -1):
            bit = bool(value >> (self.bits - 1 - k) & 1)
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def positions(self, value: int) -> np.ndarray:
        """All occurrences of a value."""
        return self.select(value, np.arange(int(self.count(value)[0])))

    def decode(self) -> np.ndarray:
        """All values, in order: from the last plane up, each plane's zeros and
        ones take their values from the front and the back of the plane below."""
        below = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k].view(np.uint8), bitorder="little")[: self.n].astype(bool)
            row = np.empty_like(below)
            row[~one] = below[: self.zeros[k]]
            row[one] = below[self.zeros[k] :] | below.dtype.type(1 << (self.bits - 1 - k))
            below = row
        return below.astype(np.uint32)
