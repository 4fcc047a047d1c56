"""Monotone integer sequences in Elias-Fano form, read by whole arrays of queries."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.full((256, 8), 8, np.uint8)  # place of the k-th set bit of a byte
for _byte in range(256):
    for _k, _place in enumerate(p for p in range(8) if _byte >> p & 1):
        _SELECT[_byte, _k] = _place


class EliasFano:
    """A non-decreasing sequence below ``universe``.

    The lower bits of each value are packed; the upper parts are written in unary, so the
    run of values with one upper part lies between two zeros of a bit vector. A
    sequence of n values takes about n * (2 + log2(universe / n)) bits and a count per byte of the upper parts.
    """

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        top = (max(universe - 1, 0) >> self.low_bits) + 1
        bits = np.zeros(-(-(n + top + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.unary = np.packbits(bits, bitorder="little")
        self.before = np.concatenate(([0], np.cumsum(_COUNT[self.unary], dtype=np.int64))).astype(np.uint32 if n < 2**32 else np.uint64)
        self.low = _pack(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)

    def arrays(self) -> list[str]:
        return ["unary", "before", "low"]

    def _select(self, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit of each rank, counted from 0."""
        byte = np.searchsorted(self.before, rank.astype(self.before.dtype), side="right") - 1
        return byte * 8 + _SELECT[self.unary[byte], rank - self.before[byte]]

    def get(self, index: np.ndarray) -> np.ndarray:
        high = self._select(index) - index
        return (high << self.low_bits) | _unpack(self.low, index, self.low_bits).astype(np.int64)

    def stretch(self, begin: int, end: int) -> np.ndarray:
        """The values from ``begin`` up to ``end``, which is quicker than to get them one by one."""
        if begin >= end:
            return np.zeros(0, np.int64)
        first, last = self._select(np.array([begin, end - 1])) >> 3
        ones = np.flatnonzero(np.unpackbits(self.unary[first : last + 1], bitorder="little")) + 8 * first
        index = np.arange(begin, end)
        high = ones[begin - int(self.before[first]) :][: end - begin] - index
        return (high << self.low_bits) | _unpack(self.low, index, self.low_bits).astype(np.int64)

    def all(self) -> np.ndarray:
        return self.stretch(0, self.n)

    def find_between(self, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Index of each value among those from ``begin`` up to ``end``, the first of equal ones, or -1.

        Searched by halving, each in its own range; nothing outside the stretch from the first range to the last is read.
        """
        out = np.full(len(values), -1)
        open_ = np.flatnonzero(begin < end)
        if not len(open_):
            return out
        base = int(begin[open_].min())
        own = self.stretch(base, int(end[open_].max()))
        first, last = begin - base, end - base
        while len(open_):
            middle = (first[open_] + last[open_]) >> 1
            below = own[middle] < values[open_]
            first[open_[below]] = middle[below] + 1
            last[open_[~below]] = middle[~below]
            open_ = open_[first[open_] < last[open_]]
        found = np.flatnonzero(first < end - base)
        hit = found[own[first[found]] == values[found]]
        out[hit] = first[hit] + base
        return out


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits one after the other, with 16 spare bytes at the end."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return np.concatenate((np.packbits(bits.ravel(), bitorder="little"), np.zeros(16, np.uint8)))


def _unpack(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    place = index * width
    byte, shift = place >> 3, (place & 7).astype(np.uint64)
    value = np.zeros(len(index), np.uint64)
    for step in range(min(8, width // 8 + 2)):
        value |= packed[byte + step].astype(np.uint64) << np.uint64(8 * step)
    value >>= shift
    if width > 56:
        value |= np.where(shift > 0, packed[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    return value & np.uint64((1 << width) - 1)


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays as read-only views of one memory-mapped file, which is gone once they are."""
    with tempfile.TemporaryFile() as file:
        places = []
        for array in arrays:
            file.write(b"\0" * (-file.tell() % 16))
            places.append(file.tell())
            file.write(np.ascontiguousarray(array).tobytes())
        file.write(b"\0")
        file.flush()
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(view, a.dtype, a.size, at).reshape(a.shape) for a, at in zip(arrays, places, strict=True)]
