"""Vectorised word and n-gram hashing over Arrow string batches.

A batch's UTF-8 buffer is viewed as one numpy array, so tokenising needs no Python loop over words.
Words are maximal runs of bytes outside a separator set; because every separator is ASCII, splitting
bytes and splitting code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of rows taken together; bounds the memory of a worker whatever the rows' lengths.
SLICE_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def release() -> None:
    """Hands freed memory back to the machine, since a Python worker lives on between tasks with all it ever took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def byte_set(chars: str) -> np.ndarray:
    """A lookup table that is True for the ASCII characters of ``chars``."""
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode("ascii"))] = True
    return out


#: ASCII white space: the characters that separate words `[^\x20\x09-\x0D]+`.
WHITE = byte_set(" \t\n\x0b\x0c\r")
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Slice:
    """Rows ``lo:hi`` of a string column as one byte array with row bounds."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, valid: np.ndarray, lo: int):
        self.data, self.bounds, self.valid, self.lo = data, bounds, valid, lo

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()


def slices(column: pa.Array) -> Iterator[Slice]:
    """Cuts a string column into slices of about SLICE_BYTES, one row at least. Null rows are empty."""
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offsets, values = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    valid = np.ones(len(column), dtype=bool) if not column.null_count else ~np.asarray(column.is_null())
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, side="right")) - 1)
        hi = min(hi, len(column))
        at = bounds[lo : hi + 1]
        yield Slice(data[at[0] : at[-1]], at - at[0], valid[lo:hi], lo)
        lo = hi
    release()


class Words:
    """Starts, ends (byte positions) and row number of every word of a slice."""

    def __init__(self, part: Slice, separators: np.ndarray = WHITE, data: np.ndarray | None = None):
        self.part = part
        self.data = part.data if data is None else data
        n, rows = len(self.data), len(part)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~separators[self.data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cut = part.bounds[1:-1]  # a word never runs over a row's end
        cut = cut[(cut > 0) & (cut < n)]
        both = cut[inside[cut] & inside[cut + 1]]
        first[both] = True
        last[both - 1] = True
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(part.bounds[1:], self.start, side="right")
        self.count = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.count)))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every task and on every machine."""
        n = len(self.data)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def windows(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every window of ``n`` words inside one row, and the index of its first word."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = out * _U(0x9FB21C651E98DF25) + hashes[k : k + size]
    at = np.flatnonzero(row[:size] == row[n - 1 :])
    return mix64(out[at]), at


def covered(size: int, at: np.ndarray, n: int) -> np.ndarray:
    """True for every word inside one of the windows of ``n`` words that begin at ``at``."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    if len(keys) == 0:
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(keys), dtype=bool)
    out[order] = twice
    return out
