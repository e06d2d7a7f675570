"""Arrow text columns as numpy bytes, and vectorised hashing of runs of bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


def releasing(run):
    """run, a function over Arrow batches, that gives freed memory back to the system when its task ends.

    Python workers live on after a task, and share their machine with others.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def row_slices(offsets: np.ndarray, max_bytes: int, max_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most so many bytes and rows each, one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), first + max_rows, rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random unsigned 64-bit integers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed) * U(0x9E3779B97F4A7C15)) * U(0xD6E8FEB86659FD93))


BYTE_VALUES = seeded(1, 256)
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64."""
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 256), 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        _POWERS[0] = np.multiply.accumulate(steps)
    return _POWERS[0]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of the bytes data[start:end] of each run; they also depend on the length.

    Runs go upwards and do not overlap. They are taken some at a time, so the
    working memory does not grow with them unless one run is very long.
    """
    lengths = ends - starts
    result = np.zeros(len(starts), np.uint64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    for i, j in row_slices(bounds, 1 << 18):
        size = lengths[i:j]
        begin = bounds[i:j] - bounds[i]
        inside = np.arange(int(bounds[j] - bounds[i])) - np.repeat(begin, size)
        if not len(inside):
            continue
        terms = BYTE_VALUES[data[np.repeat(starts[i:j], size) + inside]] * powers(int(size.max()))[inside]
        some = size > 0
        result[i:j][some] = np.add.reduceat(terms, begin[some])
    return mix(result + lengths.astype(np.uint64) * U(0xA24BAED4963EE407))


class HashIndex:
    """Open-addressing map from unsigned 64-bit keys to 32-bit numbers, for whole arrays at a time."""

    def __init__(self, slots_log2: int):
        self.shift = U(64 - slots_log2)
        self.mask = (1 << slots_log2) - 1
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.numbers = np.zeros(1 << slots_log2, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 where absent. Key 0 is never present."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.numbers[slots], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & self.mask
            held, wanted = self.keys[slots], keys[open_]
            hit = held == wanted
            found[open_[hit]] = self.numbers[slots[hit]]
            on = ~hit & (held != 0)
            open_, slots = open_[on], slots[on]
        return found

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct keys that are not present yet."""
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == 0)
            _, first = np.unique(slots[free], return_index=True)
            chosen = free[first]
            self.keys[slots[chosen]] = keys[chosen]
            self.numbers[slots[chosen]] = numbers[chosen]
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, numbers, slots = keys[rest], numbers[rest], (slots[rest] + 1) & self.mask
