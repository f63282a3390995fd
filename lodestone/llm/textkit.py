"""Vectorised helpers on UTF-8 bytes, shared by the Arrow-batch operators.

A batch of texts is one byte buffer plus row offsets. Words are runs of "word
bytes"; each word gets a 64-bit hash from prefix sums of a polynomial with
random per-byte coefficients, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_COEF = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: A few hundred kB, so that a slice's arrays of 8 bytes for each of its own stay small beside a worker.
SLICE_BYTES = 1 << 18
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 16))
        _powers[:] = []
        for base in (_BASE, _INV):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (murmur3's), so that every bit of a hash is usable."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, from 0; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(buf: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes (one long row may be more): first, last, bytes, offsets."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the range of its words (n + 1 bounds)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf) + 1, bool)
    before[0], before[1:] = False, inside
    starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
    after = np.empty(len(buf) + 1, bool)
    after[-1], after[:-1] = False, inside
    ends = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes anywhere."""
    up, down = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_COEF[buf] * up[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pair_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``width`` words of each row and the row of each; a row of fewer words is one shingle."""
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n)
    if not len(hashes):
        return hashes, rows
    left = np.repeat(bounds[1:], n) - np.arange(len(hashes))
    out = hashes
    for k in range(1, width):
        nxt = np.zeros_like(hashes)
        nxt[:-k] = hashes[k:]
        nxt[left <= k] = 0
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + nxt)
    keep = left >= width
    keep[bounds[:-1][(n > 0) & (n < width)]] = True
    return out[keep], rows[keep]


def row_unique(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their bounds by row."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(n_rows + 1))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
