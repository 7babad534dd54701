"""Whole columns of text as one byte array: slices, words and 64-bit hashes by numpy.

Everything works on bounded slices of an Arrow batch, so the memory of a task
follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
#: Slices are polynomials over the field of this prime, taken at two points.
_PRIME = (1 << 31) - 1
_POINTS = (1_403_580_283, 905_148_461)
_BYTE_VALUES = np.random.default_rng(20240607).choice(_PRIME - 1, (2, 256), replace=False).astype(np.uint64) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number with the same remainder: under 2^32 from one under 2^62."""
    return (x & _U(_PRIME)) + (x >> _U(31))


def _remainder(x: np.ndarray) -> np.ndarray:
    """The remainder modulo the prime of any number under 2^63."""
    x = _folded(_folded(_folded(x)))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _power_table(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers up and down of both points, n and more of them."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        tables = []
        for point in _POINTS:
            both = []
            for base in (point, pow(point, -1, _PRIME)):
                table = np.ones(1, _U)
                while len(table) < size:
                    table = np.concatenate([table, _remainder(table * _U(pow(base, len(table), _PRIME)))])
                both.append(table[:size].astype(np.uint32))
            tables.append(tuple(both))
        _powers[:] = tables
    return _powers


class Hashes:
    """Hashes of any slices of one byte array from two running sums.

    Two polynomials over a prime field: unlike sums modulo a power of two, they have no
    texts that are equal under every base.
    """

    def __init__(self, data: np.ndarray):
        self.sums, self.down = [], []
        for values, (up, down) in zip(_BYTE_VALUES, _power_table(len(data))):
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum(_folded(values[data] * up[: len(data)]), dtype=_U, out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (
            _remainder(_remainder(sums[ends] - sums[starts]) * down[starts]) for sums, down in zip(self.sums, self.down)
        )
        return mix(((one << _U(32)) | two) + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different slices, the place of the first of each among all, and each slice's number among them.

    Arrow's dictionary compares the bytes themselves.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.append(starts, ends[-1])
    if not (starts[1:] == ends[:-1]).all():
        lengths = ends - starts
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        data = data[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])]
    number = blobs(data, bounds).dictionary_encode().indices.to_numpy().astype(np.int64)
    # Numbers are given in the order of first slices.
    sample = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(bounds[sample].tolist(), bounds[sample + 1].tolist())], sample, number


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that hands the memory of its task back when it ends.

    Workers stay for later tasks and stages, and what their allocators keep counts on
    the executor all that time.
    """

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library, which has no such call

    return run


class Texts:
    """Some rows of a text column: ``data`` holds their bytes, row i at bounds[i]:bounds[i+1]; nulls are empty."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = column.fill_null("" if pa.types.is_string(column.type) else b"")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        self.bounds = (offsets - offsets[0]).astype(np.int64)
        raw = column.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.rows = len(column)

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The row that each byte position lies in."""
        return np.searchsorted(self.bounds, positions, side="right") - 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte positions of the rows that have any byte."""
        full = self.bounds[1:] > self.bounds[:-1]
        return self.bounds[:-1][full], self.bounds[1:][full] - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs without ASCII white space; a row's edge ends a word."""
        ink = ~_SPACE[self.data]
        starts, ends = ink.copy(), ink.copy()
        starts[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        first, last = self.edges()
        starts[first] = ink[first]
        ends[last] = ink[last]
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines between line feeds, of every row that is not empty."""
        first, last = self.edges()
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([first, feeds + 1]))
        ends = np.sort(np.concatenate([last + 1, feeds]))
        return starts, ends

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte over the rows."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def small_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows with at most ``limit`` bytes of text together, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, int(offsets[at]) + limit, side="right")) - 1
        end = min(len(column), max(at + 1, end))
        yield column.slice(at, end - at)
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def blobs(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary or string column from one byte array and row bounds."""
    return pa.Array.from_buffers(
        kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )
