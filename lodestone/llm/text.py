"""Vectorised text primitives: whole Arrow string columns in, numpy arrays out.

Nothing here loops over words or characters in Python. Null texts count as
empty. A column is cut into slices of whole rows (``row_slices``), so working
memory follows the slice limit or the one longest text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Bytes of `[\x20\x09-\x0D]`, the white space of every contract here.
SPACES = bytes([32, 9, 10, 11, 12, 13])


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = _MULTIPLIER) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, base)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection) over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One ordered hash of two hashes."""
    return mix(a * np.uint64(0x9DDFEA08EB382D69) + b)


def byte_table(separators: bytes, lower: bool = False) -> np.ndarray:
    """256 random uint64 values by byte; separators are 0, and with ``lower`` A-Z equal a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER)) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


WORDS = byte_table(SPACES)
WORDS_LOWER = byte_table(SPACES, lower=True)
LINES = byte_table(b"\n")
EVERY_BYTE = byte_table(b"")
#: Letters, digits and non-ASCII bytes, without case.
ALNUM_LOWER = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    off, i, n = buffers(column)[1], 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


class Tokens:
    """``start``, ``end`` (byte positions) and ``offsets`` (tokens by row, n + 1); hashes on demand."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.data, self.table = data, table
        n, inside = len(data), (table != 0)[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = off[:-1][off[:-1] < n]
            first[edge] = inside[edge]
            edge = off[1:][off[1:] > 0] - 1
            last[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        n = len(self.data)
        value = self.table[self.data]
        value *= powers(n)
        return mix(np.add.reduceat(value, self.start) * powers(n, _INVERSE)[self.start])


def prefix_hashes(data: np.ndarray, table: np.ndarray = EVERY_BYTE) -> np.ndarray:
    """n + 1 running sums from which ``span_hashes`` gets the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), _INVERSE)[start] + (end - start).astype(np.uint64))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring offsets; 0 where nothing is between."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
