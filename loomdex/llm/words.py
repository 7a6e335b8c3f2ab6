"""Words of Arrow text columns as NumPy arrays: where they are and what they hash to.

Whole Arrow batches are worked through in chunks of whole rows, so memory
follows ``CHUNK_BYTES`` or the longest single text, never the batch. Hashes are
64 bits wide; two different words share one with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)

#: Bytes of words: all but blank, tab, and the four line controls; or letters, digits and bytes over 127.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words(NamedTuple):
    """Words of rows ``first`` to ``first + rows`` of a batch; ``start``/``end`` are bytes of ``data``."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray  # of rows in data, rows + 1
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # of each word, from 0
    bounds: np.ndarray  # of each row's words, rows + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the public splitmix64 steps)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(8)
def randoms(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64) | U64(1)


def random_table(seed: int, n: int) -> np.ndarray:
    """At least ``n`` odd random numbers; a longer table begins with a shorter one."""
    return randoms(seed, 1 << max(10, int(n - 1).bit_length()))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(column: pa.Array, kind: np.ndarray = NOT_BLANK, lower: bool = False) -> Iterator[Words]:
    for first, data, offsets in text_chunks(column):
        if lower:
            data = LOWER[data]
        rows = len(offsets) - 1
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = kind[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[offsets] = False  # a row's first byte has nothing before it
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(offsets, start, "right") - 1
        yield Words(first, rows, data, offsets, start, end, row, np.searchsorted(row, np.arange(rows + 1)))


def word_hashes(w: Words, seed: int = 1) -> np.ndarray:
    """One hash a word: a random linear sum of its bytes, then mixed with its length."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    opens = np.zeros(len(w.data), np.int32)
    opens[w.start] = 1
    word = np.cumsum(opens, dtype=np.int32) - 1
    at = np.arange(len(w.data), dtype=np.int32) - w.start.astype(np.int32)[word]
    length = w.end - w.start
    inside = (word >= 0) & (at < length.astype(np.int32)[word])
    at[~inside] = 0
    product = random_table(seed, int(length.max()))[at] * (w.data.astype(np.uint64) + U64(1))
    product[~inside] = 0
    return mix(np.add.reduceat(product, w.start) + length.astype(np.uint64) * GOLDEN)


def window_hashes(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each ``k`` consecutive words, rows ignored: entry i covers words i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    table, total = random_table(100 + seed, k), np.zeros(n, np.uint64)
    if k <= 8:
        for j in range(k):
            total += hashes[j : j + n] * table[j]
        return mix(total)
    base = table[0] if int(table[0]) % 8 == 5 else (table[0] & ~U64(7)) | U64(5)  # an odd base of the longest period
    power = np.ones(len(hashes) + 1, np.uint64)
    power[1:] = base
    power = np.cumprod(power)
    back = np.full(n, U64(pow(int(base), -1, 1 << 64)))
    back[0] = U64(1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * np.cumprod(back))


def row_windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries of ``window_hashes`` lie within one row (as indexes), and their rows."""
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return kept, w.row[kept]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``k`` words that begins at one of ``starts``."""
    steps = np.zeros(n + k + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps)[:n] > 0
