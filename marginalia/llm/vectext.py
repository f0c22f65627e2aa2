"""Vectorised text primitives over Arrow string columns, used inside tasks.

A batch of texts is one UTF-8 byte buffer with offsets; word borders, rolling hashes and
sliding minima are NumPy passes over that buffer, so no per-word Python object is made.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15


def space_mask(buf: np.ndarray) -> np.ndarray:
    """True at the six ASCII white-space bytes."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets (n + 1); null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Join and cut batches so that a part holds about `most` bytes of text, or one row; bounds the memory of NumPy passes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.column(column).nbytes for b in held) >= most // 2:
                yield from _cut(pa.concat_batches(held) if len(held) > 1 else held[0], column, most)
                held = []
    if held:
        yield from _cut(pa.concat_batches(held) if len(held) > 1 else held[0], column, most)


def settle() -> None:
    """Give memory that this worker no longer uses back to the machine; a worker is kept for later tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _cut(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    _, at = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor, shift), so that all output bits depend on all input bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward, backward = np.full(size, _ODD, U64), np.full(size, pow(_ODD, -1, 1 << 64), U64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward, dtype=U64), np.cumprod(backward, dtype=U64)


class Prefix:
    """Prefix sums of a polynomial hash modulo 2**64: the hash of any span in constant time."""

    def __init__(self, buf: np.ndarray) -> None:
        size = 1 << max(16, int(len(buf)).bit_length())
        forward, self.back = _powers(size)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * forward[: len(buf)], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def words(buf: np.ndarray, at: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each run of bytes that are not blank; white space is, unless a mask says otherwise."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    blank = space_mask(buf) if blank is None else blank
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before, after = cut[:n].copy(), cut[1:].copy()
    before[1:] |= blank[:-1]
    after[:-1] |= blank[1:]
    begin, end = np.flatnonzero(before & ~blank), np.flatnonzero(after & ~blank) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def runs(values: np.ndarray) -> np.ndarray:
    """Begin of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def runs_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Begin of each run of equal neighbouring pairs."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
