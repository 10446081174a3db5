"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

All functions work on slices of about `SLICE` bytes, so that the memory of a
task is bounded by a slice or, if longer, by one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in `ranges` (both ends included)."""
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first:last + 1] = True
    return out


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACED = ~table([(0x20, 0x20), (0x09, 0x0D)])                      # words between white space
ALNUM = table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])  # digits, letters, everything beyond ASCII


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only the largest table asked for is kept."""
    size = max(2 * SLICE, 1 << int(least).bit_length())
    if _TABLES and max(_TABLES) >= size:
        return _TABLES[max(_TABLES)]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]))
    _TABLES.clear()
    _TABLES[size] = up, down
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


@dataclass
class Words:
    """Words of the texts `first` to `last` of a column."""

    first: int
    last: int
    starts: np.ndarray   # byte positions within the slice
    ends: np.ndarray
    hashes: np.ndarray   # 64-bit, of the folded word
    bounds: np.ndarray   # bounds[i]:bounds[i + 1] are the words of text first + i
    data: np.ndarray     # the bytes of the slice
    offsets: np.ndarray  # of the texts within the slice

    @property
    def texts(self) -> int:
        return self.last - self.first

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(column: pa.Array, inside: np.ndarray = SPACED, size: int = SLICE) -> Iterator[Words]:
    """Cut texts into maximal runs of the bytes in `inside`; hashes fold A-Z."""
    for first, last, data, offsets in slices(column, size):
        n = len(data)
        keep = np.zeros(n + 2, dtype=bool)
        keep[1:-1] = inside[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(keep[1:] & (~keep[:-1] | edge))
        ends = np.flatnonzero(keep[:-1] & (~keep[1:] | edge))
        up, down = powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((FOLD[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * down[starts])
        yield Words(first, last, starts, ends, hashes, np.searchsorted(starts, offsets), data, offsets)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte position, the end included."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
