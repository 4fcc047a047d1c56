"""Words of an Arrow batch of texts as numpy arrays: rows, byte ranges and 64-bit hashes.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return. Hashes do not depend on the batch, the position or
the machine, so they can be joined on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(32)
_MIX_A, _MIX_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    kept = _powers.get(name)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, BATCH_BYTES + 1), base & (2**64 - 1), np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if n <= 4 * BATCH_BYTES:
            _powers[name] = kept
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values so that any part of them can serve as a hash."""
    h = h ^ (h >> _SHIFT)
    h = h * _MIX_A
    h ^= h >> _SHIFT
    h *= _MIX_B
    return h ^ (h >> _SHIFT)


@dataclass
class Words:
    """Words of ``n_rows`` texts in order: ``data[start:end]`` is a word of text ``row``."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)

    def firsts(self) -> np.ndarray:
        """Index of the first word of each text; one more entry holds the number of words."""
        return np.concatenate(([0], np.cumsum(self.counts())))

    def _prefix(self) -> np.ndarray:
        if not hasattr(self, "_sums"):
            terms = _BYTE_CODES[self.data]
            terms *= _power(_ODD, len(self.data), "up")
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])
            self._inverse = _power(pow(_ODD, -1, 2**64), len(self.data) + 1, "down")
        return self._sums

    def hashes(self, head: int | None = None) -> np.ndarray:
        """One hash per word, or per first ``head`` bytes of each word."""
        sums = self._prefix()
        end = self.end if head is None else np.minimum(self.end, self.start + head)
        return mix((sums[end] - sums[self.start]) * self._inverse[self.start])


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets, rebased to zero; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _runs(inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``inside``; a run also ends before each index in ``breaks``."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    after = np.concatenate((inside[1:], [False])) if n else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    data, offsets = text_buffers(texts)
    if lower:
        data = lower_ascii(data)
    start, end = _runs(~is_space(data), offsets)
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, row, start, end, len(texts))


def split_classes(texts: pa.Array) -> Words:
    """Runs of letters, runs of digits and runs of one and the same sign; case is kept."""
    data, offsets = text_buffers(texts)
    letter = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    digit = (data >= 48) & (data <= 57)
    kind = np.where(letter, 1, np.where(digit, 2, data.astype(np.int16) + 3))
    changes = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start, end = _runs(~is_space(data), np.union1d(offsets, changes))
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, row, start, end, len(texts))


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``max_bytes`` at most; a longer text comes alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > max_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)
