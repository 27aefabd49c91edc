"""Vectorised text access over Arrow string columns.

A column of texts is seen as one array of UTF-8 bytes plus row offsets, so
that tokenising and hashing run as a handful of numpy passes instead of a loop
over rows.  Words are the runs of bytes other than space and U+0009-U+000D and
ASCII letters are lower-cased; both rules are byte-safe in UTF-8.

Words and shingles are identified by 64-bit fingerprints.  Two different words
share one with probability about n^2 / 2^65 for n distinct words (below 1e-5
for ten million words).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
EMPTY_HASH = np.empty(0, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 fingerprints (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not this C library
    _TRIM = None


def release() -> None:
    """Give freed memory back to the system: Python workers wait for their next task with all that they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def row_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) pieces of about ``most`` bytes, whole rows each."""
    raw, at = text_buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    release()


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one entry more than rows)."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_WS[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running sums from which the fingerprint of any span follows."""
    powers, _ = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODE[raw] * powers[: len(raw)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans, the same for equal bytes wherever they stand."""
    _, inverse = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of lower-cased bytes, and each row's first word index."""
    starts, ends, rows = word_bounds(raw, at)
    if not len(starts):
        return EMPTY_HASH, rows
    return span_hash(prefix_hash(raw), starts, ends), rows


_LANE = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64)]


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for each tuple of fingerprints, order included."""
    out = parts[0] * _LANE[0]
    for k, p in enumerate(parts[1:], 1):
        out = mix(out) + p * _LANE[k % 64]
    return mix(out)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` words and each one's row; rows with fewer words give one run of all."""
    n_rows, counts = len(rows) - 1, np.diff(rows)
    if not len(hashes):
        return EMPTY_HASH, np.empty(0, np.int64)
    owner = np.repeat(np.arange(n_rows), counts)
    m = len(hashes) - size + 1
    out, own = EMPTY_HASH, np.empty(0, np.int64)
    if m > 0:
        inside = owner[:m] == owner[size - 1 :]
        at = np.flatnonzero(inside)
        out, own = combine([hashes[at + k] for k in range(size)]), owner[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([combine([hashes[rows[r] + k : rows[r] + k + 1] for k in range(counts[r])])[0] + np.uint64(counts[r]) for r in short], dtype=np.uint64)
        out, own = np.concatenate([out, mix(extra)]), np.concatenate([own, short])
    return out, own


def distinct_pairs(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, key) pairs, ordered by owner then key."""
    if not len(owner):
        return owner, keys
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    return o[new], k[new]


class HashIndex:
    """Positions of known fingerprints; about 30 ns a lookup, whatever the cache holds."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, dtype=np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(4, min(22, int(len(keys)).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        slots = (self.keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.first).max()) if len(keys) else 0
        self.padded = np.concatenate([self.keys, np.zeros(1, np.uint64)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index in the given keys of each fingerprint, -1 where unknown."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        live = np.flatnonzero(at < end)
        for step in range(self.depth):
            place = at[live] + step
            hit = self.padded[place] == h[live]
            out[live[hit]] = self.order[place[hit]]
            live = live[~hit & (place + 1 < end[live])]
            if not len(live):
                break
        return out


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 fingerprints as the int64 that Spark's bigint holds."""
    return h.view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, dtype=np.int64).view(np.uint64)
