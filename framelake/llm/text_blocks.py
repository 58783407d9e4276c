"""Whole Arrow columns of text as numpy arrays: slices of bounded bytes, words, word hashes, shingles.

Words are maximal runs of bytes other than blank and 0x09-0x0D, with A-Z lower-cased. In UTF-8 no byte of a
multi-byte character is one of these, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(_BASE))


_BYTE_CODE = _series(256, 11)
_POSITION = _series(SHINGLE, 911) | np.uint64(1)
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64; kept up to the usual slice length."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    size = max(n, SLICE_BYTES + (SLICE_BYTES >> 2)) if n <= 2 * SLICE_BYTES else n
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 2 * SLICE_BYTES:
        _powers[:] = made
    return made[0], made[1]


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with 64-bit offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array with 64-bit offsets; no copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    got = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return got[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of a batch with at most about ``limit`` bytes of text (one longer text stands alone)."""
    column = as_strings(batch.column(text))
    _, at = raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), column.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()


def _running(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power(len(data))[0][:len(data)], out=total[1:])
    return total


def _range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((total[end] - total[start]) * _power(len(total) - 1)[1][start] + (end - start).astype(np.uint64))


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by differences of one running sum."""
    return _range_hash(_running(data), start, end)


def text_hash(word: str) -> int:
    """The hash that ``Words`` gives a word."""
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(byte_hash(data, np.array([0]), np.array([len(data)]))[0])


class Words:
    """Words of a slice of texts: byte ranges, 64-bit hashes, and the first word of each text."""

    def __init__(self, column: pa.Array, apart: np.ndarray = BLANKS):
        """``apart`` marks the bytes that part words."""
        data, at = raw(column)
        self.data = LOWER[data]
        self.at = at
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        inside = ~apart[data]
        first = inside & edge[:-1]
        first[1:] |= inside[1:] & ~inside[:-1]
        last = inside & edge[1:]
        last[:-1] |= inside[:-1] & ~inside[1:]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text i are first[i]..first[i+1]
        self.first = np.searchsorted(self.start, at)
        self._total = _running(self.data)
        self.hash = _range_hash(self._total, self.start, self.end)

    def prefix_hash(self, size: int) -> np.ndarray:
        """Hash of the first bytes of each word; of the whole word if it is shorter."""
        return _range_hash(self._total, self.start, np.minimum(self.start + size, self.end))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def shingle_sets(self, width: int = SHINGLE) -> list[np.ndarray]:
        """Per text the sorted distinct hashes of its runs of ``width`` words; a shorter text is one run."""
        h = self.hash
        n = len(h)
        runs = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            runs += h[k:k + len(runs)] * _POSITION[k]
        runs = mix64(runs)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(runs[a:b - width + 1]))
            elif b > a:
                short = (h[a:b] * _POSITION[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix64(np.array([short ^ np.uint64(_BASE)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
