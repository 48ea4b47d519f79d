"""Vectorised tokenising and hashing of whole Arrow text batches with numpy.

A slice of a batch is one byte array plus document offsets. Words, word hashes, shingle
hashes and sliding minima are computed for all documents of the slice at once, so the cost
is a few passes over the bytes; a slice holds at most ``SLICE_BYTES`` (or one longer
document), which bounds memory whatever the batch holds.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
#: bytes of words hashed at a time, or one longer word
PIECE = 128 << 10
U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_BASE = U(0x100000001B3)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: white-space separated words: anything but 0x20 and 0x09-0x0D
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: letters and digits (after lower-casing) and every byte of a non-ASCII code point
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_POW = np.ones(1 << 12, dtype=np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, _POW.size):
        _POW[_i] = _POW[_i - 1] * _BASE
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BACK = np.ones(1, dtype=np.uint64)
_CODE = mixed = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0..n-1 (wrapping)."""
    global _POW
    while _POW.size < n:
        with np.errstate(over="ignore"):
            _POW = np.concatenate([_POW, _POW * (_POW[-1] * _BASE)])
    return _POW[:n]


def backwards(n: int) -> np.ndarray:
    """The inverse of _BASE to the powers 0..n-1 (wrapping)."""
    global _BACK
    while _BACK.size < n:
        with np.errstate(over="ignore"):
            _BACK = np.concatenate([_BACK, _BACK * (_BACK[-1] * _INVERSE)])
    return _BACK[:n]


#: bytes that a worker may grow by until lean() gives back what is free
SLACK = 96 << 20
_resident = 0


def trim(slack: int = SLACK) -> None:
    """Gives free memory back to the system if the process has grown by more than slack since the last time."""
    global _resident
    try:
        with open("/proc/self/statm") as f:
            now = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:
        return
    if now <= _resident + slack:
        _resident = min(now, _resident or now)
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
    with open("/proc/self/statm") as f:
        _resident = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def lean(run):
    """A function for mapInArrow whose worker gives back what a task has left free: workers stay, idle, beside the tasks that follow."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in run(batches):
            yield batch
            del batch
            trim()
        trim(8 << 20)

    return each


def lean_group(run):
    """The same of a function for applyInArrow, after each group."""

    def each(table: pa.Table) -> pa.Table:
        out = run(table)
        del table
        trim()
        return out

    return each


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """Words of a slice: start and end bytes, the first word of each document, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.low = low = LOWER[data]
        n = low.size
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = kind[low]
        edge = inside[1:] & ~inside[:-1]  # first bytes of words
        edge[offsets[:-1][np.diff(offsets) > 0]] |= inside[1:][offsets[:-1][np.diff(offsets) > 0]]
        first = np.zeros(n + 1, dtype=bool)  # also a document's end ends a word
        first[offsets] = True
        self.start = np.flatnonzero(edge[:n])
        last = inside[1:-1] & (~inside[2:] | first[1:])
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, offsets)  # word number at which each document begins
        self.count = np.diff(self.doc)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not self.start.size:
            return np.zeros(0, np.uint64)
        out = np.empty(self.start.size, np.uint64)
        a = 0
        while a < out.size:
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + PIECE)))
            start, end, low = self.start[a:b] - self.start[a], self.end[a:b] - self.start[a], self.low[self.start[a] : self.end[b - 1]]
            with np.errstate(over="ignore"):
                # a word's codes by the powers of their places, as a difference of sums over all bytes before
                total = np.empty(low.size + 1, np.uint64)
                total[0] = 0
                np.cumsum(_CODE[low] * powers(low.size), out=total[1:])
                total = (total[end] - total[start]) * backwards(low.size)[start]
                out[a:b] = mix(total ^ ((end - start).astype(np.uint64) * _MULT))
            a = b
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, for each start (h.size-k+1 of them); documents are not looked at."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n] * U(1)
        for i in range(1, k):
            out = out * _BASE + h[i : i + n]
        return mix(out + U(k) * _MULT)


def valid_runs(doc: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for starts whose k items lie in one document; n starts."""
    ok = np.ones(max(n, 0), dtype=bool)
    for i in range(1, k):
        at = doc[1:-1] - i
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def owner(doc: np.ndarray, n: int) -> np.ndarray:
    """The document of each of n items, from the items at which documents begin."""
    return np.repeat(np.arange(doc.size - 1), np.diff(np.minimum(doc, n)))


_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """An array by planes of bytes, those of the highest value alone, compressed."""
    whole = x.view(f"u{x.itemsize}")
    top = (int(whole.max()).bit_length() + 7) // 8 if x.size else 0
    each = np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize)
    planes = np.empty((top, x.size), np.uint8)
    for i in range(top):
        planes[i] = each[:, i]
    return bytes([top]) + _CODEC.compress(planes.tobytes(), asbytes=True)


def unsqueeze(body: bytes, n: int, kind: type) -> np.ndarray:
    top = body[0]
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    planes = np.frombuffer(_CODEC.decompress(memoryview(body)[1:], n * top, asbytes=True), np.uint8).reshape(top, n)
    for i in range(top):
        out[:, i] = planes[i]
    return out.view(kind).ravel()
