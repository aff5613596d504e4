"""Whole-batch text primitives shared by the corpus operators.

Spark hands text to Python as Arrow buffers; everything here works on those
buffers with numpy, so no Python code runs per row or per token.

A *token* is a maximal run of word bytes of the lower-cased UTF-8 text: ASCII
letters, digits, underscore and every non-ASCII byte.  A token is represented
by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum() or _c == 95

_VALUE = (np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93)) ^ U64(0xA5A3564C4F5D2B19)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release_memory() -> None:
    """Give freed memory back to the machine; workers otherwise keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # another C library than glibc


def tidy(run: Batches) -> Batches:
    """Run over a partition's batches and leave no freed memory behind."""

    @wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return outer


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is several times faster than np.unique here."""
    x = np.sort(x)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            base = np.full(size, _BASE, dtype=U64)
            base[0] = 1
            back = np.full(size, _INVERSE, dtype=U64)
            back[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(back)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, so that temporaries stay small."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), start + SLICE_ROWS, n)
        yield start, stop
        start = stop


@dataclass
class Tokens:
    """Tokens of a range of rows; token t lies in row `row[t]` of the range."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    """first[r] is the index of row r's first token; one more entry than rows."""

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.hash)) - self.first[self.row]


def spans_of(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask, which also end at row bounds."""
    n = len(mask)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    inner = bounds[bounds < n]
    begins[inner] = mask[inner]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    last = bounds[bounds > 0] - 1
    ends[last] = mask[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, from one prefix sum over all bytes."""
    up, down = POWERS.get(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum(_VALUE[raw] * up[:-1], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def tokenize(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of the rows that `offsets` cuts out of lower-cased bytes."""
    base = offsets[0]
    raw = raw[base : offsets[-1]]
    bounds = offsets - base
    start, end = spans_of(_WORD[raw], bounds)
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Tokens(start, end, span_hashes(raw, start, end), row, first)


def token_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, end row, tokens) of a string column, slice by slice."""
    raw, offsets = text_buffers(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    for a, b in slices(offsets, limit):
        yield a, b, tokenize(raw, offsets[a : b + 1])


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive values (n-1 fewer than values)."""
    if len(tokens) < n:
        return np.zeros(0, dtype=U64)
    up, down = POWERS.get(len(tokens) + 1)
    prefix = np.zeros(len(tokens) + 1, dtype=U64)
    np.cumsum(tokens * up[:-1], out=prefix[1:])
    return mix64((prefix[n:] - prefix[:-n]) * down[: len(tokens) - n + 1])


def binary_column(rows: np.ndarray) -> pa.Array:
    """Rows of a C-contiguous 2-D array as a binary column."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    fixed = pa.Array.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows))])
    return fixed.cast(pa.binary())


def ragged_binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values[first[i]:first[i+1]] as the i-th binary value."""
    offsets = (first * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
