"""Byte-level numpy helpers shared by the training-data operators.

All of them work on one block of texts at a time: the concatenated UTF-8 bytes of a few thousand
documents, as Arrow hands them over. Blocks are bounded in bytes (a longer single text is a block of its
own), so memory does not depend on the size of a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


@lru_cache(maxsize=1)
def _libc():
    """The C library, told to give large blocks back to the system as they are freed; None where it can't be told.

    Workers are kept between tasks, and several share an executor's memory, so what one has freed must not stay with it.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # from this size on, a block is mapped by itself
        libc.mallopt(-1, 16 << 20)  # free memory at the top that is kept
        return libc
    except (OSError, AttributeError):
        return None


def tidy(batches: Iterator) -> Iterator:
    """The same; at the end, memory that is free goes back to the system."""
    libc = _libc()
    yield from batches
    if libc is not None:
        libc.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most max_bytes bytes, or one row."""
    for batch in tidy(batches):
        n = batch.num_rows
        if not n:
            continue
        _, offsets = buffer_of(batch.column(text))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each begins. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators, and the first run of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = np.empty(len(data) + 1, bool)
    np.logical_not(is_sep[data], out=word[1:])
    word[0] = False
    edge = word[1:] & ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    edge[inner] |= word[1:][inner]
    starts = np.flatnonzero(edge)
    stop = np.empty(len(data), bool)
    stop[:-1] = word[1:-1] & ~word[2:]
    stop[-1] = word[-1]
    stop[inner - 1] |= word[inner]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64; kept for reuse."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, U64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[int(base)] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); works in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial by prefix sums, then mixed with the length."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + step, side="right")), at + 1)
        lo, hi = starts[at], ends[to - 1]
        prefix = np.zeros(hi - lo + 1, U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * powers(hi - lo, BASE), out=prefix[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (prefix[e] - prefix[s]) * powers(hi - lo + 1, BASE_INV)[s]
        at = to
    out ^= (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out)


def hash_windows(items: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of all windows of `size` consecutive 64-bit items, from prefix sums, mixed."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = U64((0xC2B2AE3D27D4EB4F + 2 * seed) | 1)
    inverse = U64(pow(int(base), -1, 1 << 64))
    prefix = np.zeros(len(items) + 1, U64)
    np.cumsum(items * powers(len(items), base), out=prefix[1:])
    out = (prefix[size:] - prefix[:-size]) * powers(n, inverse)
    return mix(out)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` consecutive values, by doubling."""
    out, have = values, 1
    while have < size:
        by = min(have, size - have)
        out = np.minimum(out[: len(out) - by], out[by:])
        have += by
    return out


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words at which a window of `size` words of one text begins, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(begin, counts) + np.repeat(first[:-1], counts), doc


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges starts[i] .. starts[i] + counts[i] - 1, one range after the other."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
