"""Byte-level BPE by a queue of ranks: a bitmap in levels over buckets of list positions.

Every merge rank owns a bucket of positions in a doubly linked list of tokens;
a bitmap in levels marks the ranks whose bucket holds something, and
find-first-set goes down the levels to the lowest. Positions whose pair has
changed since they were queued are stale and skipped. The tokens of all pieces
of a batch lie in one list, so one bucket is merged for all of them at once,
and a very long piece costs no more per byte than many short ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loadweave.llm.columns import HashIndex, row_slices, text_bytes
from loadweave.llm.pieces import PieceIds

NONE = np.int32(1 << 30)
END = (1 << 31) - 1
SLICE_BYTES = 4 << 20


class RankQueue:
    """Positions by rank; pop() gives the lowest rank that has any."""

    WIDTH = 64

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = -(-ranks // self.WIDTH)
            self.levels.append([0] * ranks)
            if ranks <= 1:
                break
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) == 0:
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, held in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            self.add(rank, held)

    def add(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            rank, bit = divmod(rank, self.WIDTH)
            before = level[rank]
            level[rank] = before | 1 << bit
            if before:
                break

    def pop(self) -> tuple[int, np.ndarray] | None:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = at * self.WIDTH + (word & -word).bit_length() - 1
        rank = at
        for level in self.levels:
            at, bit = divmod(at, self.WIDTH)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Merges:
    """The vocabulary of a rank file: which pair of tokens makes which token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.size = max(ranks.values()) + 1
        if self.size > END:
            raise ValueError("a vocabulary of more than 2**31 - 1 tokens")
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = HashIndex(int(np.ceil(np.log2(max(16, 4 * len(pairs))))))
        # Keys are moved up by one: 0 marks a free slot.
        self.pairs.add(np.fromiter(pairs, np.uint64, len(pairs)) + np.uint64(1), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.find((left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1))
        return np.where(found < 0, NONE, found)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # Each piece is followed by an end mark that pairs with nothing.
        marks = np.cumsum(sizes + 1) - 1 if len(sizes) else np.zeros(0, np.int64)
        n = int(marks[-1]) + 1 if len(sizes) else 0
        token = np.full(n, END, np.int32)
        inner = np.ones(n, bool)
        inner[marks] = False
        token[inner] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int64)
        before = np.arange(-1, n - 1, dtype=np.int64)
        if n:
            after[-1], before[0] = n - 1, n - 1
        pair = self.rank(token, token[after]) if n else np.zeros(0, np.int32)
        queue = RankQueue(self.size)
        ready = np.flatnonzero(pair != NONE)
        queue.push(pair[ready], ready)
        alive = inner.copy()
        while (popped := queue.pop()) is not None:
            rank, at = popped
            at = np.unique(at)
            at = at[pair[at] == rank]
            if not len(at):
                continue
            at, later = self._now(rank, at, token, after, before, marks)
            if len(later):
                queue.add(rank, later)
            second = after[at]
            third = after[second]
            alive[second] = False
            pair[second] = NONE
            token[at] = rank
            after[at] = third
            before[third] = at
            left = before[at]
            pair[at] = self.rank(token[at], token[third])
            pair[left] = self.rank(token[left], token[at])
            changed = np.concatenate([at, left])
            changed = changed[pair[changed] != NONE]
            queue.push(pair[changed], changed)
        counts = np.add.reduceat(alive.astype(np.int64), np.concatenate([[0], marks[:-1] + 1])) if n else np.zeros(0, np.int64)
        return token[alive], counts

    def _now(self, rank, at, token, after, before, marks) -> tuple[np.ndarray, np.ndarray]:
        """The positions to merge now, and those to queue again.

        From left to right, a position whose left token the merge before it
        takes is stale. If a merge makes a pair of lower rank, the positions
        after it in the same piece have to wait for that pair.
        """
        touches = np.zeros(len(at), bool)
        touches[1:] = after[at[:-1]] == at[1:]
        if touches.any():
            index = np.arange(len(at))
            run = np.maximum.accumulate(np.where(touches, 0, index))
            keep = (index - run) % 2 == 0
            now = at[keep]
        else:
            now = at
        follows = np.zeros(len(now), bool)
        follows[1:] = after[after[now[:-1]]] == now[1:]
        left = np.where(follows, rank, token[before[now]])
        made = np.full(len(now), rank, np.int32)
        lower = np.minimum(self.rank(left, made), self.rank(made, token[after[after[now]]])) < rank
        if not lower.any():
            return now, at[:0]
        owner = np.searchsorted(marks, now)
        stops = np.full(len(marks), np.iinfo(np.int64).max)
        np.minimum.at(stops, owner[lower], now[lower])
        later = at > stops[np.searchsorted(marks, at)]
        return now[now <= stops[owner]], at[later]

    def decode(self, ids: np.ndarray) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(merges(path).encode)


def binary_rows(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Little-endian 32-bit ids as one binary value per row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values, "<u4"))]).cast(pa.binary())


def encode_column(texts: pa.Array, vocabulary: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids one after the other, ids per row) of stretches of a string column; null as empty."""
    table = piece_ids(vocabulary)
    data, offsets = text_bytes(texts)
    for i, j in row_slices(offsets, SLICE_BYTES):
        low = offsets[i]
        yield i, j, *table.rows(data[low : offsets[j]], offsets[i : j + 1] - low)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds a binary column of little-endian unsigned 32-bit ids, and n_tokens.

    vocabulary: a rank file. Null text counts as empty and gives no id. Other
    columns pass through, repeated rows too; columns that have the new names
    are replaced.
    """
    kept = docs.drop(*{ids, "n_tokens"} - {text})
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, counts in encode_column(batch.column(batch.schema.get_field_index(text)), vocabulary):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, binary_rows(values, counts), pa.array(counts, pa.int64())], names=[*batch.schema.names, ids, "n_tokens"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null. A column of that name is replaced."""
    kept = encoded.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = merges(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [None if v.as_py() is None else vocab.decode(np.frombuffer(v.as_py(), "<u4")) for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)
