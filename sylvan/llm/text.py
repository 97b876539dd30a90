"""Vectorised word spans and word hashes over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. Whole texts are handled; a batch is cut into
slices of whole rows of about ``SLICE`` bytes, so that memory follows the slice (or the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 6 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= B
    x ^= x >> np.uint64(27)
    x *= C
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes, one row at least."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one entry more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    full = ~space[data]
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    inner = at[(at > 0) & (at < len(data))]
    begin[inner] = full[inner]
    end[inner - 1] = full[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: whole 8-byte loads, the last of them ending at the word's end."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    load = np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))
    n = ends - starts
    h = mix((load[starts] & KEEP[np.minimum(n, 8)]) + n.astype(np.uint64) * A)
    long = np.flatnonzero(n > 8)
    h[long] = mix(h[long] * A + load[ends[long] - 8])
    step = 8
    while len(long := long[n[long] > step + 8]):
        h[long] = mix(h[long] * A + load[starts[long] + step])
        step += 8
    return h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; the last n-1 entries are missing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size, done, out = 1, 0, None
    power, block = np.full(1, A), h
    while True:
        if n & size:
            part = block[done : done + len(h) - n + 1]
            out = part.copy() if out is None else out * power + part
            done += size
        size *= 2
        if size > n:
            return mix(out)
        half = size // 2
        block = block[:-half] * power + block[half:]
        power = power * power


def words_of(column: pa.Array, lower: bool, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, end row, bytes, word starts, word ends, first word of each row."""
    data, at = raw(column)
    for a, b in slices(data, at, most):
        part = data[at[a] : at[b]]
        part = LOWER[part] if lower else part
        yield a, b, part, *spans(part, at[a : b + 1] - at[a])
