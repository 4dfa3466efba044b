"""Arrow strings as numpy byte arrays, words and substring hashes: the vectorised base of the text operators.

Everything here runs inside a Spark task on a slice of a batch, so memory is bounded by SLICE bytes or one text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes together; a longer text is taken alone.
SLICE = 1 << 20
#: The same where a step holds many 64-bit values of each byte; the longest usual texts fit.
NARROW = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``most`` bytes."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, back, np.uint64)]))
    return up, down


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to ``size`` at least; only the usual lengths stay in memory."""
    for usual in (NARROW, SLICE):
        if size <= usual + 1:
            return _powers(usual + 1)
    return _powers.__wrapped__(size)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit integers (the finaliser of splitmix64, a fixed public function)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@functools.cache
def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each byte, by rule."""
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1)) * _BASE)


class Hashes:
    """Polynomial hashes of all substrings of ``data`` from one prefix sum, modulo 2**64."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.up, self.down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            terms = byte_values(seed)[data]
            terms *= self.up[: len(data)]
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_OTHER = np.uint64(0xD6E8FEB86659FD93)  # odd, and no power of the other base in reach


@functools.cache
def _other_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(_OTHER), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_OTHER, back))


class Strings:
    """Hashes of substrings of 8 bytes or more by the 8-byte strings in them, each mixed on its own, with another base."""

    def __init__(self, data: np.ndarray):
        n = max(0, len(data) - 7)
        self.up, self.down = next((_other_powers(x + 1) for x in (NARROW, SLICE) if n <= x + 1), None) or _other_powers.__wrapped__(n)
        own = np.ascontiguousarray(data)
        with np.errstate(over="ignore"):
            terms = np.ndarray((n,), np.uint64, own.data, 0, (1,)) * _BASE if n else np.zeros(0, np.uint64)
            terms ^= terms >> np.uint64(29)
            terms *= self.up[:n]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end - 7] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def table(allowed) -> np.ndarray:
    """Truth for each byte value."""
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: All but space and the control bytes 9 to 13.
NOT_SPACE = table(set(range(256)) - {0x20, 9, 10, 11, 12, 13})
#: Digits, ASCII letters and all bytes of non-ASCII characters.
WORDY = table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of maximal runs of ``inside`` bytes; none crosses a row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    flag = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = flag.copy()
    first[1:] &= ~flag[:-1] | cut[1:n]
    last = flag.copy()
    last[:-1] &= ~flag[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def batches(arrays: dict[str, object], schema: pa.Schema, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of at most ``rows`` rows, so that the JVM never holds a large one."""
    whole = pa.record_batch([pa.array(arrays[f.name], f.type) if not isinstance(arrays[f.name], pa.Array) else arrays[f.name] for f in schema], schema=schema)
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)
