"""Words of many texts at once, as numpy arrays over Arrow's UTF-8 bytes.

The operators that look at every word of the corpus (shingles, windows, repeated passages) work
on one array of 64-bit word hashes per slice of documents instead of on Python strings.  A word
is a run of bytes outside a separator set; every separator used here is ASCII, so splitting the
UTF-8 bytes gives the same words as splitting the characters.

Hashes depend only on the bytes (never on the process), so equal words hash alike on every
executor.  A window's hash is a multilinear hash of its word hashes, in one or two independent
64-bit halves.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: word separators of `[^\x20\x09-\x0D]+`
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: texts are hashed in slices of about this many bytes (cut at separators), which bounds memory
SLICE_BYTES = 1 << 20

_U = np.uint64


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps none of the last."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def _random_odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = _random_odd(11, 256)
_BASE = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying the text; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type)
    if not large and not pa.types.is_string(column.type):
        column, large = column.cast(pa.large_string()), True
    valid, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.diff(off)[column.is_null().to_numpy(zero_copy_only=False)].any():
        return utf8(pc.fill_null(column, ""))  # bytes under a NULL
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def row_slices(off: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each (one long text makes a range alone)."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


@dataclass
class Words:
    """The words of rows ``lo..hi``: byte span, row (counted from ``lo``) and hash of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[r] .. first[r + 1]: the words of row r

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _table(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


def _hash_slice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None) -> np.ndarray:
    lens = ends - starts
    total = int(lens.sum())
    at = np.cumsum(lens) - lens
    k = np.arange(total, dtype=np.int64) - np.repeat(at, lens)  # place of each byte in its word
    b = data[np.repeat(starts, lens) + k]
    if fold is not None:
        b = fold[b]
    power = np.multiply.accumulate(np.full(int(lens.max()) + 1, _BASE, np.uint64))
    return mix(np.add.reduceat(_BYTE[b] * power[k], at) + lens.astype(np.uint64))


#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def split_words(data: np.ndarray, off: np.ndarray, lo: int, hi: int, separators: bytes = SPACE, lower: bool = False, hashes: bool = True) -> Words:
    """The words of rows ``lo..hi``; a text's end ends its last word."""
    is_word = _table(separators)
    b0, b1 = int(off[lo]), int(off[hi])
    m = is_word[data[b0:b1]]
    edge = np.zeros(b1 - b0 + 1, bool)
    edge[off[lo : hi + 1] - b0] = True  # rows begin and end here
    before = np.empty(len(m), bool)
    if len(m):
        before[0] = False
        before[1:] = m[:-1]
    start = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty(len(m), bool)
    if len(m):
        after[-1] = False
        after[:-1] = m[1:]
    end = np.flatnonzero(m & (~after | edge[1:])) + 1
    first = np.searchsorted(start, off[lo : hi + 1] - b0)
    row = np.repeat(np.arange(hi - lo), np.diff(first))
    start += b0
    end += b0
    h = np.zeros(0 if not hashes else len(start), np.uint64)
    if hashes:
        at = 0
        while at < len(start):  # a slice of whole words at a time
            to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, side="right")))
            h[at:to] = _hash_slice(data, start[at:to], end[at:to], LOWER if lower else None)
            at = to
    return Words(start, end, row, h, first)


def window_hash(word: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of the ``width`` words that start at each place (length ``len(word) - width + 1``)."""
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    r = _random_odd(1000 * seed + width, width)
    h = word[:n] * r[0]
    for k in range(1, width):
        h += word[k : n + k] * r[k]
    return mix(h)


def inside(row: np.ndarray, width: int) -> np.ndarray:
    """Whether the window that starts at each place ends in the same row."""
    n = len(row) - width + 1
    return row[: max(n, 0)] == row[width - 1 :] if n > 0 else np.zeros(0, bool)


def cover_spans(start: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over ``n`` places: inside any of the spans ``start .. start + width``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(start + width, n), -1)
    return np.cumsum(d[:-1]) > 0
