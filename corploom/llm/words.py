"""Vectorised words and shingles of whole texts: hashes over Arrow buffers, no per-word Python objects.

A word is a run of bytes outside [\\x20\\x09-\\x0D] of the UTF-8 text with A-Z lower-cased.
Hashes are 64-bit; equal words have equal hashes, different ones collide with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, so that temporaries stay at some tens of MB.
CHUNK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit depends on all (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse, kept for the longest chunk so far (recomputed beyond CHUNK_BYTES)."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            up, down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
            if n > 4 * CHUNK_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, row offsets into bytes) for runs of rows of about CHUNK_BYTES; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last - first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in raw, and how many words precede each row (rows + 1 values)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] |= solid[edges]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[inner > 0] - 1
    stops[inner] |= solid[inner]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets, side="left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash for each word: a polynomial over its bytes modulo 2**64, taken from one running sum."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words (as if all words were one row)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = mix(out + words[k : k + n] * np.uint64(2 * k + 3))
    return out


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a row that has some words but fewer than a shingle."""
    return shingle_hashes(words, len(words))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def document_shingles(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct shingle hashes in ascending order) of each row; fewer words than width make one shingle, none make none."""
    powers = _Powers()
    for first, rows, raw, offsets in text_chunks(column):
        starts, ends, before = word_bounds(raw, offsets)
        words = word_hashes(raw, starts, ends, powers)
        runs = shingle_hashes(words, width)
        for k in range(rows):
            a, b = before[k], before[k + 1]
            if b - a >= width:
                yield first + k, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield first + k, whole_hash(words[a:b])
            else:
                yield first + k, np.zeros(0, dtype=np.uint64)


def flat_shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """All shingle hashes of the column's rows, repeats included, in some order."""
    powers = _Powers()
    for _, rows, raw, offsets in text_chunks(column):
        starts, ends, before = word_bounds(raw, offsets)
        words = word_hashes(raw, starts, ends, powers)
        runs = shingle_hashes(words, width)
        keep = np.ones(len(runs), dtype=bool)
        for k in range(1, width):  # runs that cross into the next row
            cut = before[1:-1] - k
            keep[cut[(cut >= 0) & (cut < len(runs))]] = False
        yield runs[keep]
        for k in np.flatnonzero((np.diff(before) < width) & (np.diff(before) > 0)):
            yield whole_hash(words[before[k] : before[k + 1]])
