"""Packs token sequences into rows of fixed capacity: exact complements first, then best fit.

Only lengths matter for the plan, so it is made from the histogram of lengths,
which has at most `capacity` entries whatever the number of documents. The
longest length is taken first; single, pair and triple sums of the lengths
still available are indexed for the gap it leaves, and combinations that fill
the gap exactly are consumed as often as their counts allow. What has no exact
complement goes, longest first, into the row with the smallest gap that holds
it. The plan says which ranks within a length go where; documents get their
rank by counts per bucket and a window within (bucket, length).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.bpe import binary_rows
from loadweave.llm.columns import releasing, row_slices, text_bytes
from loadweave.llm.pieces import PieceIds
from loadweave.session import stage

SLICE_BYTES = 4 << 20
ROWS_PER_BUCKET = 100_000


class Share(NamedTuple):
    """Ranks [first, first + times * each) of a length: `each` side by side in `times` sequences from `sequence` on."""

    length: int
    first: int
    times: int
    each: int
    sequence: int
    offset: int


class _Plan:
    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.used = np.zeros_like(counts)
        self.sequences = 0
        self.shares: list[Share] = []

    def take(self, length: int, times: int, each: int, sequence: int, offset: int) -> None:
        self.shares.append(Share(length, int(self.used[length]), times, each, sequence, offset))
        self.used[length] += times * each
        self.left[length] -= times * each

    def row(self, lengths: list[int], times: int) -> int:
        """So many new sequences that begin with these lengths; returns the first of them."""
        sequence, offset = self.sequences, 0
        self.sequences += times
        for length in lengths:
            self.take(length, times, 1, sequence, offset)
            offset += length
        return sequence


def _pairs(left: np.ndarray, total: int) -> np.ndarray:
    """The lengths a <= total - a of which a pair with that sum is available."""
    a = np.arange(1, total // 2 + 1)
    ok = (left[a] > 0) & (left[total - a] > 0)
    if total % 2 == 0 and len(a):
        ok[-1] = left[total // 2] > 1
    return a[ok]


def _complement(left: np.ndarray, gap: int, most: int) -> list[int] | None:
    """One, two or three (at most `most`) available lengths that fill the gap, the fewest possible."""
    if left[gap] > 0:
        return [gap]
    if most < 2:
        return None
    pairs = _pairs(left, gap)
    if len(pairs):
        return [gap - int(pairs[-1]), int(pairs[-1])]
    if most < 3:
        return None
    for longest in (np.flatnonzero(left[1 : gap - 1]) + 1)[::-1].tolist():
        if 3 * longest < gap:
            break
        left[longest] -= 1
        pairs = _pairs(left, gap - longest)
        left[longest] += 1
        if len(pairs):
            return [longest, gap - longest - int(pairs[-1]), int(pairs[-1])]
    return None


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[Share], int]:
    """Where the pieces of each length go, and the number of sequences.

    Filling gaps with several short pieces can use up what longer ones need
    later, so plans with sums of up to three, two and one lengths are made and
    the one with the fewest sequences is taken.
    """
    plans = [_plan(histogram, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda plan: plan[1])


def _plan(histogram: dict[int, int], capacity: int, most: int) -> tuple[list[Share], int]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        counts[length] = n
    plan = _Plan(counts)
    if counts[capacity]:
        plan.row([capacity], int(counts[capacity]))
    rest = np.zeros_like(counts)
    for length in range(capacity - 1, 0, -1):
        while plan.left[length]:
            plan.left[length] -= 1
            others = _complement(plan.left, capacity - length, most)
            plan.left[length] += 1
            if others is None:
                rest[length] += plan.left[length]
                plan.left[length] = 0
                break
            lengths = [length, *others]
            needed = {x: lengths.count(x) for x in lengths}
            plan.row(lengths, min(int(plan.left[x]) // n for x, n in needed.items()))
    plan.left = rest
    _best_fit(plan, capacity)
    return plan.shares, plan.sequences


def _best_fit(plan: _Plan, capacity: int) -> None:
    """Longest first, each into the sequence with the smallest gap that holds it."""
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)

    def leave(gap: int, sequence: int, times: int) -> None:
        if gap and times:
            open_.setdefault(gap, []).append((sequence, times))

    for length in range(capacity, 0, -1):
        for gap in sorted(g for g in open_ if g >= length):
            while plan.left[length] and open_.get(gap):
                sequence, times = open_[gap].pop()
                each = gap // length
                full = min(times, int(plan.left[length]) // each)
                if full:
                    plan.take(length, full, each, sequence, capacity - gap)
                    leave(gap - each * length, sequence, full)
                some = int(plan.left[length]) if full < times else 0
                if some:
                    plan.take(length, 1, some, sequence + full, capacity - gap)
                    leave(gap - some * length, sequence + full, 1)
                    full += 1
                leave(gap, sequence + full, times - full)
            if not open_.get(gap):
                open_.pop(gap, None)
        if n := int(plan.left[length]):
            each = capacity // length
            full, some = divmod(n, each)
            if full:
                plan.take(length, full, each, plan.sequences, 0)
                leave(capacity - each * length, plan.sequences, full)
                plan.sequences += full
            if some:
                plan.take(length, 1, some, plan.sequences, 0)
                leave(capacity - some * length, plan.sequences, 1)
                plan.sequences += 1


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> PieceIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    return PieceIds(encode)


def cut(values: np.ndarray, counts: np.ndarray, capacity: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends every row with end_id and cuts rows of more than `capacity` ids.

    Returns the ids, and per piece its row, number, start and length. All
    pieces of a row but the first are full.
    """
    sizes = counts + 1
    ends = np.cumsum(sizes)
    ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    ids[inner] = values
    pieces = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = sizes - (pieces - 1) * capacity
    start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
    length = np.where(number == 0, first[row], capacity)
    return ids, row, number, start, length


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids: the token ids of every text, cut to the capacity.

    tokenizer: a byte-level BPE file of the tokenizers library. Strings of
    special tokens in a text are ordinary text; a null text counts as empty and
    gives the end id alone. ids holds little-endian unsigned 32-bit integers.
    Other columns of docs are left out.
    """
    name = docs.schema[key]
    schema = T.StructType([name, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tokenizer(tokenizer)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets, SLICE_BYTES):
                low = offsets[i]
                values, counts = table.rows(data[low : offsets[j]], offsets[i : j + 1] - low)
                ids, row, number, start, length = cut(values, counts, capacity, end_id)
                keys = batch.column(0).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary_rows(ids, length)], names=[key, "piece", "start", "length", "ids"])

    return docs.select(key, text).mapInArrow(releasing(run), schema)


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length", key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `capacity` tokens.

    `pieces` is read three times (counts, ranks, histogram), so it should be a
    stored table without the token ids. Equal rows are told apart by their
    rank only. Columns sequence_id and offset are replaced. A null length is
    left out.
    """
    kept = pieces.drop("sequence_id", "offset").filter(F.col(length).isNotNull())
    size, bucket, rank, base = "_size", "_bucket", "_rank", "_base"
    n = kept.count()
    buckets = max(kept.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_BUCKET))
    kept = kept.withColumns({size: F.col(length).cast("int"), bucket: F.pmod(F.xxhash64(key, "piece") if "piece" in kept.columns else F.xxhash64(key), F.lit(buckets)).cast("int")})
    counts = stage(kept.groupBy(size, bucket).count(), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("count")).collect()}
    shares, _ = plan_packing(histogram, capacity)
    before = counts.select(size, bucket, (F.sum("count").over(Window.partitionBy(size).orderBy(bucket)) - F.col("count")).alias(base))
    order = [F.col(key), *([F.col("piece")] if "piece" in kept.columns else [])]
    ranked = kept.join(before, [size, bucket]).withColumn(rank, F.col(base) + F.row_number().over(Window.partitionBy(size, bucket).orderBy(*order)) - 1)

    table = np.array(sorted(shares), np.int64).reshape(-1, len(Share._fields))
    # Ranks of all lengths on one line: lengths follow each other by a wide step.
    step = 1 << 44
    begins = table[:, 0] * step + table[:, 1]
    out = T.StructType([*kept.drop(size, bucket).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = out.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {x: batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in (size, rank)}
            share = table[np.searchsorted(begins, at[size] * step + at[rank], "right") - 1]
            inside = at[rank] - share[:, 1]
            sequence = share[:, 4] + inside // share[:, 3]
            offset = share[:, 5] + inside % share[:, 3] * share[:, 0]
            columns = [batch.column(batch.schema.get_field_index(x)) for x in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(releasing(place), out)
