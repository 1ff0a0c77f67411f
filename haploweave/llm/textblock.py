"""Whole texts as UTF-8 byte blocks for vectorised work in Arrow batches.

A block is the pair (bytes, offsets) of consecutive rows. Batches are cut into
blocks of about ``BLOCK`` bytes at row ends, so temporary arrays stay bounded by
the block or by the one text that is longer than it.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_LIBC = ctypes.CDLL(None)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_T = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def trim() -> None:
    """Give freed memory back to the system, so that an idle Python worker does not keep the peak of its last task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each block."""
    data, offs = utf8(column)
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Spans:
    """64-bit hashes of stretches data[s:e] of one block: differences of one running polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            powers = np.full(n, _P, np.uint64)
            powers[:1] = 1
            np.cumprod(powers, out=powers)
            self.total = np.empty(n + 1, np.uint64)
            self.total[0] = 0
            np.cumsum(_T[data] * powers, out=self.total[1:])
            powers[:] = _INV
            powers[:1] = 1
            np.cumprod(powers, out=powers)
        self.back = powers

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[e] - self.total[s]) * self.back[s] + (e - s).astype(np.uint64))


def spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch data[s:e]."""
    return Spans(data)(s, e)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: a 64-bit hash of each and the row of each, in text order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = spans(LOWER[data], s, e)
    return h, np.searchsorted(offs, s, "right") - 1


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in text order with their row starts (length rows + 1). A row of fewer words has its whole sequence as one; a row without words has none."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(out)])
    begin = np.repeat(first[:-1], out) + np.arange(to[-1]) - np.repeat(to[:-1], out)
    size = np.repeat(np.minimum(count, k), out)
    with np.errstate(over="ignore"):
        x = size.astype(np.uint64)
        for j in range(k):
            at = begin + j
            part = h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else at.astype(np.uint64)
            x = x + np.where(j < size, part * _R[j % 16] ^ (part >> np.uint64(29)), np.uint64(0))
            x = mix(x)
    return x, to


def crc_mod(ids: list, m: int) -> np.ndarray:
    """crc32 of each id as text, mod m; a null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % m for x in ids], np.int64)


class Lookup:
    """Positions of 64-bit keys in an array of distinct keys: open hashing in a few vectorised rounds."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.rounds = keys.astype(np.uint64), []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            table = np.full(1 << max(4, int(len(left) * 3).bit_length()), -1, np.int32)
            slot = self._slot(self.keys[left], len(self.rounds), len(table))
            table[slot] = left
            self.rounds.append(table)
            left = left[table[slot] != left]

    def _slot(self, keys: np.ndarray, turn: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys ^ (keys >> np.uint64(31))) * _R[turn % 16]) >> np.uint64(65 - size.bit_length())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        todo = None
        for turn, table in enumerate(self.rounds):
            part = keys if todo is None else keys[todo]
            at = table[self._slot(part, turn, len(table))]
            hit = (at >= 0) & (self.keys[at] == part)
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero(~hit & (at >= 0))
            else:
                out[todo[hit]] = at[hit]
                todo = todo[~hit & (at >= 0)]
            if not len(todo):
                break
        return out
