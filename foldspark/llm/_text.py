"""Vectorised words and word hashes over Arrow string columns: no Python object for each word.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A word's 64-bit hash is a polynomial over its bytes
modulo 2**64, mixed; texts are taken whole, in slices of documents of about ``SLICE`` bytes (a longer document is a
slice of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        m = max(n, SLICE + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(m, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE):
    """(first row, end row, bytes, offsets of the rows in the bytes) of slices of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice in order, and the number of words of each row."""
    n = len(data)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.zeros(0, np.uint64), counts
    gap = _SEP[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = gap[:-1]
    first[offsets[(offsets > 0) & (offsets < n)]] = True
    starts = np.flatnonzero(first & ~gap)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    up, down = _tables(n)
    value = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n]
    value[gap] = 0
    h = mix(np.add.reduceat(value, starts) * down[starts])
    edge = np.searchsorted(starts, offsets)
    return h, np.diff(edge)
