"""Whole Arrow batches of text as numpy arrays: word spans, word hashes, row slices.

Every function works on one *block*: the UTF-8 bytes of some documents laid end to end
(``data``) and the document boundaries in them (``offs``).  A block holds at most
``BLOCK_BYTES`` bytes unless a single document is longer, so memory is bounded by the longest
document and not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: Freed memory that a worker keeps between blocks.
KEPT_BYTES = 1 << 26
#: Parameters of the C library's mallopt.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTE_VALUES = mix64((np.arange(1, 257, dtype=U64)) * U64(_STEP))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INVERSE, U64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 4 * BLOCK_BYTES:
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows; null is empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, raw = column.buffers()
    offs = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end
    give_back()


def give_back() -> None:
    """Return the memory that freed arrays leave with the allocators, so that workers are small between batches."""
    pa.default_memory_pool().release_unused()
    trim = _libc_trim()
    if trim is not None:
        trim(0)


@lru_cache(1)
def keep_memory() -> None:
    """From now on this worker keeps up to ``KEPT_BYTES`` of freed memory until ``give_back``, so that arrays of the next block fault in no new pages."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library
        return
    mallopt(_MMAP_THRESHOLD, KEPT_BYTES // 4)
    mallopt(_TRIM_THRESHOLD, KEPT_BYTES)


@lru_cache(1)
def _libc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


ASCII_SPACE = byte_table(b" \t\n\x0b\x0c\r")
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of ``inside`` that no document boundary crosses."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offs[1:-1]
    before[edges[edges < n]] = False
    edges = edges[edges > 0]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span's bytes; equal bytes give equal hashes anywhere."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_STEP))


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document numbers of the words of a block, in order."""
    starts, ends, doc = spans(~separators[data], offs)
    return span_hashes(data, starts, ends), doc


def counts_by_doc(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many items each document has, and where its items begin (one more entry at the end)."""
    count = np.bincount(doc, minlength=n).astype(np.int64)
    return count, np.concatenate(([0], np.cumsum(count)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), end to end."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def sets_by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, end to end, and where each document's begin."""
    _, first = counts_by_doc(doc, n)
    values = values.copy()
    for a, b in zip(first[:-1], first[1:]):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    doc = doc[keep]
    return values[keep], counts_by_doc(doc, n)[1]


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all runs of ``size`` words; a shorter text is one run of all its words."""
    seeds = mix64(np.arange(1, size + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
    count, first = counts_by_doc(doc, n_docs)
    m = len(word) - size + 1
    if m > 0:
        full = doc[:m] == doc[size - 1 :]
        total = np.zeros(m, U64)
        for j in range(size):
            total += mix64(word[j : j + m] * seeds[j])
        got, got_doc = mix64(total)[full], doc[:m][full]
    else:
        got, got_doc = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        total = count[short].astype(U64) * U64(_STEP)
        for j in range(size - 1):
            has = count[short] > j
            total[has] += mix64(word[first[short][has] + j] * seeds[j])
        got, got_doc = np.concatenate((got, mix64(total ^ U64(0x94D049BB133111EB)))), np.concatenate((got_doc, short))
        order = np.argsort(got_doc, kind="stable")
        got, got_doc = got[order], got_doc[order]
    return got, got_doc
