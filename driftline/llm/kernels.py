"""NumPy kernels over the raw UTF-8 buffers of Arrow string columns.

All functions work on whole slices of a batch at once: a slice is the
concatenated bytes of some rows plus their offsets, so no Python loop runs
per word or per byte.  Slices are kept near ``SLICE_BYTES`` (a longer row is a
slice of its own), which bounds a worker's memory whatever the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: ASCII white space: space and the bytes 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Anything that is neither an ASCII letter or digit nor part of a multi-byte character.
NON_WORD = np.ones(256, bool)
NON_WORD[0x80:] = False
NON_WORD[ord("0") : ord("9") + 1] = False
NON_WORD[ord("a") : ord("z") + 1] = False
NON_WORD[ord("A") : ord("Z") + 1] = False


def _byte_table(seed: int, fold: bool) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=U64)
    if fold:
        t[ord("A") : ord("Z") + 1] = t[ord("a") : ord("z") + 1]
    return t


#: Random 64-bit value of each byte; the folded one gives A-Z the values of a-z.
BYTES = _byte_table(20260101, False)
BYTES_FOLDED = _byte_table(20260101, True)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept and doubled on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        done = 1
        while done < size:
            step = U64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _powers[base] = have
    return have[:n]


def release() -> None:
    """Give freed memory back to the system: Python workers outlive tasks, and what their allocators
    keep would add up beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``f`` over whole groups, with memory given back after each that is not small."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        if table.nbytes > SLICE_BYTES:
            release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        if left.nbytes + right.nbytes > SLICE_BYTES:
            release()
        return out

    return one if f.__code__.co_argcount == 1 else two  # Spark tells the kinds apart by their arguments


def released_after(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over batches, with memory given back at the end of the partition."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of about ``limit`` bytes."""
    data, off = buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-separator bytes; a run never crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~separator[data]
    first, last = word.copy(), word.copy()
    np.logical_and(word[1:], ~word[:-1], out=first[1:])
    np.logical_and(word[:-1], ~word[1:], out=last[:-1])
    full = off[:-1] < off[1:]
    head, tail = off[:-1][full], off[1:][full] - 1
    first[head] = word[head]
    last[tail] = word[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def prefix_sums(data: np.ndarray, table: np.ndarray = BYTES_FOLDED) -> np.ndarray:
    """Running sums of table[byte] * base**position; two of them give the hash of any span."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    v = table[data]
    v *= _power_table(_BASE, len(data))
    np.cumsum(v, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, independent of where the span lies."""
    h = sums[end] - sums[start]
    h *= _power_table(_BASE_INV, len(sums))[start]
    return mix(h + (end - start).astype(U64))


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words within a row.  A row of 1 to k-1 words gives one
    shingle of all its words; a row without words gives none.  Ordered by row and position."""
    n = len(words)
    counts = np.bincount(row, minlength=rows)
    if n >= k:
        m = n - k + 1
        h = words[:m].copy()
        for i in range(1, k):
            h = h * U64(0xC2B2AE3D27D4EB4F) + words[i : m + i]
            h ^= h >> U64(29)
        same = row[:m] == row[k - 1 :]
        full, full_row = mix(h[same] ^ U64(k)), row[:m][same]
    else:
        full, full_row = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return full, full_row
    first = np.searchsorted(row, short)
    h = words[first].copy()
    for i in range(1, k - 1):
        go = counts[short] > i
        x = h[go] * U64(0xC2B2AE3D27D4EB4F) + words[first[go] + i]
        h[go] = x ^ (x >> U64(29))
    h = mix(h ^ counts[short].astype(U64))
    all_row = np.concatenate([full_row, short])
    order = np.argsort(all_row, kind="stable")
    return np.concatenate([full, h])[order], all_row[order]


def sort_rows(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``value`` with each row's part ascending; ``ends``: where the rows end.  One call of the
    vectorised sort per row is far cheaper than an indirect sort by (row, value)."""
    out = value.copy()
    at = 0
    for end in ends.tolist():
        if end - at > 1:
            out[at:end].sort()
        at = end
    return out


def distinct_by_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending; ``row`` must be ascending."""
    if not len(value):
        return value, row
    value = sort_rows(value, np.cumsum(np.bincount(row, minlength=rows)))
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], row[keep]
