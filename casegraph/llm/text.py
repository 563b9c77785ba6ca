"""Vectorised text helpers on the byte buffers of Arrow string columns.

A block is a run of whole rows of at most about `limit` bytes (one longer row is a block of its own), so that
the arrays made from it stay small whatever the size of the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 64  # bytes
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
WORDY = np.zeros(256, bool)  # digits, a-z and all of non-ASCII, after lower-casing
WORDY[48:58] = WORDY[97:123] = WORDY[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(at: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, one row at least."""
    start, n = 0, len(at) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = end


def word_parts(data: np.ndarray, at: np.ndarray, keep: np.ndarray, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The block itself; where it is one longer row, parts of it of some `limit` bytes that end between words (runs of bytes for which
    keep holds), so that no word is cut."""
    lo, n, limit = 0, len(data), limit or PIECE_BYTES
    if len(at) != 2 or n <= limit:
        yield data, at
        return
    while lo < n:
        hi = min(n, lo + limit)
        while hi < n:  # on to the next byte that is in no word
            free = np.flatnonzero(~keep[data[hi : hi + limit]])
            if len(free):
                hi += int(free[0])
                break
            hi = min(n, hi + limit)
        yield data[lo:hi], np.array([0, hi - lo])
        lo = hi


def point_parts(data: np.ndarray, at: np.ndarray, carry: int, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Code points of the block, their offsets, and 0; where it is one longer row, of parts of it, each after the last `carry` code points
    of the part before (as many as the third value says), so that what runs over a cut can be counted in the later part."""
    lo, n, limit = 0, len(data), limit or PIECE_BYTES
    if len(at) != 2 or n <= limit:
        yield (*code_points(data, at), 0)
        return
    before = np.zeros(0, np.uint32)
    while lo < n:
        hi = min(n, lo + limit)
        while hi < n and (data[hi] & 0xC0) == 0x80:
            hi += 1
        new = code_points(data[lo:hi], np.array([0, hi - lo]))[0]
        points = np.concatenate([before, new])
        yield points, np.array([0, len(points)]), len(before)
        before, lo = points[len(points) - min(carry, len(points)) :], hi


def hashed_words(data: np.ndarray, at: np.ndarray, keep: np.ndarray, limit: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 64-bit hashes of words (runs of bytes for which keep holds), A-Z lower-cased; at starts at 0.

    A longer row is taken in parts that end between words, so that what it needs beside its words is bounded.
    """
    if len(data) <= limit:
        low = LOWER[data]
        row, start, end = words(low, at, keep)
        return row, word_hashes(low, start, end)
    rows, hashes, lo, n = [], [], 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        while hi < n:  # on to the next byte that is in no word
            free = np.flatnonzero(~keep[LOWER[data[hi : hi + limit]]])
            if len(free):
                hi += int(free[0])
                break
            hi = min(n, hi + limit)
        first = np.searchsorted(at, lo, "right") - 1
        row, h = hashed_words(data[lo:hi], np.clip(at[first:] - lo, 0, hi - lo), keep, hi - lo)
        rows.append(row + first)
        hashes.append(h)
        lo = hi
    return np.concatenate(rows), np.concatenate(hashes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes.

    Eight bytes at a time, each time through the finaliser, so no arrangement of a word's letters cancels out; longer
    words one by one by BLAKE2b.
    """
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = length.astype(np.uint64) * np.uint64(_BASE)
    live, k = np.flatnonzero(length <= LONG_WORD), 0
    while len(live):
        left = np.minimum(length[live] - k, 8)
        h[live] = mix64(h[live] ^ (eight[start[live] + k] & _MASKS[left]))
        k += 8
        live = live[length[live] > k]
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the overlapping data[start:end] in linear work, equal for equal bytes. A polynomial modulo 2**64: for short
    spans and hashed features, not for texts of which some were made to meet."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the maximal runs of bytes for which keep holds; runs never cross rows. at starts at 0."""
    good = keep[data]
    before = np.empty_like(good)
    before[1:] = good[:-1]
    before[:1] = False
    inner = at[:-1][at[:-1] < len(data)]
    before[inner] = False
    start = np.flatnonzero(good & ~before)
    after = np.empty_like(good)
    after[:-1] = good[1:]
    after[-1:] = False
    last = at[1:][at[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(good & ~after) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def shingles(row: np.ndarray, hashes: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all runs of width words; a row of fewer words, but not none, gives its whole sequence as one."""
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    out, rows = [], []
    if len(hashes) >= width:
        ok = row[: len(hashes) - width + 1] == row[width - 1 :]
        out.append(_chain([hashes[k : len(hashes) - width + 1 + k][ok] for k in range(width)]))
        rows.append(row[: len(hashes) - width + 1][ok])
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            out.append(_chain([hashes[first[short] + k] for k in range(n)]))
            rows.append(short)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(rows, kind="stable")
    return rows[order], out[order]


def _chain(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + p)
    return h


def distinct_by_row(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row, then value, without repeats."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return row[new], values[new]


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets in them. at starts at 0."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begun = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
    return points, begun[at]
