"""Splits text into the pieces that byte-level BPE encodes one by one, and remembers their ids.

The split is that of the published pattern (contractions, letters, numbers,
other signs, white space), computed on whole columns of UTF-8 bytes. A piece is
encoded once per worker, looked up by hash afterwards, and compared by its bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from loadweave.llm.columns import HashIndex, hash_runs, row_slices

LETTER, NUMBER, SPACE, OTHER = range(4)
# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK_BYTES = 1 << 20


@cache
def char_classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = char_classes()
    classes = table[:256][b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        padded = np.concatenate([b, np.zeros(3, np.uint8)]).astype(np.int32)
        first = padded[lead]
        tail = [padded[lead + k] & 0x3F for k in (1, 2, 3)]
        point = np.where(
            first < 0xE0,
            (first & 0x1F) << 6 | tail[0],
            np.where(first < 0xF0, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]),
        )
        kind = table[np.minimum(point, 0x10FFFF)]
        classes[lead] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            has = first >= least
            classes[lead[has] + k] = kind[has]
    return classes


def piece_starts(b: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start; no piece crosses a row."""
    n = len(b)
    if n == 0:
        return np.zeros(0, np.int64)
    classes = byte_classes(b)
    row = np.zeros(n + 1, bool)
    row[row_starts] = True
    row[[0, n]] = True
    start = row.copy()
    start[1:n] |= classes[1:] != classes[:-1]
    begin = np.flatnonzero(start)
    begin, end = begin[:-1], begin[1:]
    kind = classes[begin]

    # Of white space before something else, the last character stands apart; a plain space joins what follows.
    last = end[(kind == SPACE) & ~row[end]]
    tail = last - 1
    for _ in range(3):
        tail = tail - ((b[tail] & 0xC0) == 0x80)
    start[tail] = True
    start[last[b[tail] == 0x20]] = False

    # Contractions: a lone apostrophe that begins a piece, with the letters after it.
    lone = (kind == OTHER) & (end - begin == 1) & (b[begin] == 0x27) & start[begin] & ~row[end]
    after = end[lone]
    after = after[classes[after] == LETTER]
    if len(after):
        one = b[after]
        two = np.where(row[after + 1], 0, b[np.minimum(after + 1, n - 1)])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        size = np.where(single, 1, np.where(pair, 2, 0))
        after, size = after[size > 0], size[size > 0]
        start[after] = False
        start[after + size] = True
    return np.flatnonzero(start[:n])


def equal_runs(data: np.ndarray, starts: np.ndarray, other: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[start : start + length] and other[place : place + length] are equal; no length is 0."""
    equal = np.ones(len(starts), bool)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    for i, j in row_slices(bounds, 1 << 18):
        begin = bounds[i:j] - bounds[i]
        step = np.arange(int(bounds[j] - bounds[i]))
        unequal = data[step + np.repeat(starts[i:j] - begin, lengths[i:j])] != other[step + np.repeat(places[i:j] - begin, lengths[i:j])]
        if unequal.any():
            equal[i:j] = ~np.logical_or.reduceat(unequal, begin)
    return equal


class PieceIds:
    """Ids of pieces, remembered by hash with their bytes, up to bounds; beyond them the memory starts anew.

    A piece takes remembered ids only if its bytes are the same. Pieces that share a
    hash with another one are encoded by themselves.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], slots_log2: int = 21, max_bytes: int = 16 << 20):
        """encode: distinct pieces to all their ids in a row, and how many each has."""
        self.encode, self.slots_log2, self.max_bytes = encode, slots_log2, max_bytes
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex(self.slots_log2)
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)
        self.place = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and the number of ids of each row."""
        if len(self.first) > (1 << self.slots_log2) // 2 or len(self.bytes) + 4 * len(self.ids) > self.max_bytes:
            self._clear()
        starts, hashes = [], []
        for i, j in row_slices(offsets, BLOCK_BYTES):
            low, high = offsets[i], offsets[j]
            block = data[low:high]
            s = piece_starts(block, offsets[i:j] - low)
            hashes.append(hash_runs(block, s, np.append(s[1:], len(block))) | np.uint64(1))
            starts.append(s + low)
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        numbers = self._numbers(data, starts, np.append(starts[1:], len(data)), hashes)
        counts = self.count[numbers]
        total = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.searchsorted(starts, offsets)
        per_row = np.diff(total[bounds])
        where = np.arange(total[-1], dtype=np.int64) + np.repeat(self.first[numbers] - total[:-1], counts)
        return self.ids[where], per_row

    def _numbers(self, data, starts, ends, hashes) -> np.ndarray:
        numbers = self.index.find(hashes)
        lengths = ends - starts
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, example, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            example = missing[example]
            base = self._add([data[a:z].tobytes() for a, z in zip(starts[example].tolist(), ends[example].tolist())])
            # The index holds half of its slots; the rest of a very varied slice is not found again.
            room = max(0, (1 << self.slots_log2) // 2 - base)
            self.index.add(new[:room], np.arange(base, base + len(new), dtype=np.int32)[:room])
            numbers[missing] = base + inverse
        other = np.flatnonzero(self.length[numbers] != lengths)
        alike = np.flatnonzero(self.length[numbers] == lengths)
        other = np.concatenate([other, alike[~equal_runs(data, starts[alike], self.bytes, self.place[numbers[alike]], lengths[alike])]])
        if len(other):
            pieces = [data[a:z].tobytes() for a, z in zip(starts[other].tolist(), ends[other].tolist())]
            distinct = {piece: k for k, piece in enumerate(dict.fromkeys(pieces))}
            numbers[other] = self._add(list(distinct)) + np.array([distinct[piece] for piece in pieces])
        return numbers

    def _add(self, pieces: list[bytes]) -> int:
        """Encodes distinct pieces and returns the number of the first; the others follow."""
        ids, count = self.encode(pieces)
        base = len(self.first)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.place = np.concatenate([self.place, len(self.bytes) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        return base
