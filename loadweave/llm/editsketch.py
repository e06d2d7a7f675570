"""Fingerprints of texts by a randomised embedding of edit distance into Hamming distance.

All texts walk over their characters with shared random bits: step j writes the
current character and moves to the next one if bit (j, character) is set. Two
walks that an insertion or deletion has set apart meet again soon, so texts at
a small edit distance have walks at a small Hamming distance.

A fingerprint samples the walk at places whose hash has enough trailing zeros,
enough being the least number that leaves about 128 to 256 places. Walks of
similar length are sampled at the same places, and a coarser sample is part of
a finer one, so any two fingerprints can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.columns import U, mix, row_slices
from loadweave.session import stage

CLASSES, PERIOD = 64, 1 << 16
SAMPLES = 256
SLICE_CHARS = 4 << 20
FEW = 24  # texts still walking, below which they go on one by one
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@cache
def _char_class() -> np.ndarray:
    return (mix(np.arange(0x110000, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(5)) >> U(58)).astype(np.uint8)


@cache
def _stays() -> np.ndarray:
    """How many steps a character of a class takes that starts at a step: until the first set bit. Periodic."""
    bits = (mix(np.arange(CLASSES * PERIOD, dtype=np.uint64) + U(0xABCDEF)) >> U(63)).astype(bool).reshape(CLASSES, PERIOD)
    stays = np.ones((CLASSES, PERIOD), np.uint8)
    twice = np.concatenate([bits, bits], axis=1)
    waiting = np.full((CLASSES,), 0, np.int64)
    for j in range(2 * PERIOD - 1, -1, -1):
        waiting = np.where(twice[:, j], 1, waiting + 1)
        if j < PERIOD:
            stays[:, j] = np.minimum(waiting, 255)
    return stays.ravel()


_LEVELS: dict[int, tuple[int, np.ndarray]] = {}


def places(level: int, below: int) -> np.ndarray:
    """The sampled places of a level below a step, ascending."""
    end, held = _LEVELS.get(level, (0, np.zeros(0, np.int64)))
    if end < below:
        end = max(below, SAMPLES << level)
        parts = []
        for low in range(0, end, 1 << 20):
            steps = np.arange(low, min(low + (1 << 20), end), dtype=np.uint64)
            parts.append(low + np.flatnonzero(mix(steps + U(0x51ED270B)) & U((1 << level) - 1) == 0))
        held = np.concatenate(parts)
        _LEVELS[level] = (end, held)
    return held[: np.searchsorted(held, below)]


def walks(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character starts, and the number of steps of each text. codes: classes of characters."""
    stays, mask = _stays(), PERIOD - 1
    begins = np.zeros(len(codes), np.int64)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    first, size = offsets[:-1][order], sizes[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    together = int(np.searchsorted(-active, -FEW + 1, "left"))
    row = codes.astype(np.int32) * PERIOD
    at = np.zeros(len(order), np.int64)
    for i, n in enumerate(active[:together].tolist()):
        place = first[:n] + i
        step = at[:n]
        begins[place] = step
        at[:n] = step + stays[row[place] + (step & mask)]
    for t in range(int(active[together]) if together < len(active) else 0):
        step, start = int(at[t]), int(first[t] + together)
        end = int(first[t] + size[t])
        out = []
        for c in row[start:end].tolist():
            out.append(step)
            step += int(stays[c + (step & mask)])
        begins[start:end] = out
        at[t] = step
    total = np.zeros(len(order), np.int64)
    total[order] = at
    return begins, total


def fingerprints(texts: list[str]) -> list[str]:
    """Two digits of the level, then one hexadecimal digit for each sampled place."""
    result = [""] * len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(sizes, kind="stable")
    for i, j in row_slices(np.concatenate([[0], np.cumsum(sizes[order])]), SLICE_CHARS):
        chosen = order[i:j]
        offsets = np.concatenate([[0], np.cumsum(sizes[chosen])])
        codes = _char_class()[np.frombuffer("".join([texts[k] for k in chosen]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins, steps = walks(codes, offsets)
        digits = HEX[codes & 15]
        for k, low, high, n in zip(chosen.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), steps.tolist()):
            level = max(0, (max(n, 1) - 1).bit_length() - SAMPLES.bit_length() + 1)
            at = np.searchsorted(begins[low:high], places(level, n), "right") - 1
            result[k] = f"{level:02d}" + digits[low:high][at].tobytes().decode()
    return result


def likeness(a: str, b: str) -> float:
    """The share of equal places among those that either fingerprint samples at the coarser level of the two; 1 if both are empty."""
    level = max(int(a[:2]), int(b[:2]))
    x, y = (_at_level(s, level) for s in (a, b))
    most = max(len(x), len(y))
    if most == 0:
        return 1.0
    n = min(len(x), len(y))
    return float(np.count_nonzero(x[:n] == y[:n])) / most


def _at_level(fingerprint: str, level: int) -> np.ndarray:
    own = int(fingerprint[:2])
    digits = np.frombuffer(fingerprint[2:].encode(), np.uint8)
    if own == level or not len(digits):
        return digits
    # The n-th sampled place of the finer level, for as many places as there are digits.
    end = SAMPLES << own
    while len(finer := places(own, end)) < len(digits):
        end *= 2
    return digits[np.isin(finer[: len(digits)], places(level, int(finer[len(digits) - 1]) + 1))]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(keys: list, texts: list[str]) -> list[dict]:
    """One row for every text but the last, which is only the text after."""
    import hashlib

    edited = []
    for text, after in zip(texts, texts[1:]):
        n = len(text) // 4
        edited.append(text[: len(text) - n] + after[:n])
    found = fingerprints(texts + edited)
    own, other = found[: len(texts)], found[len(texts) :]
    return [
        {"key": k, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": f, "edited_fingerprint": g, "near_edited": likeness(f, g), "near_next": likeness(f, h)}
        for k, t, e, f, g, h in zip(keys, texts, edited, own, other, own[1:])
    ]


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every whole text; null counts as empty. A column of that name is replaced."""
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(texts), pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


DONE, HEAD, PENDING = range(3)
COMPARE_CHARS = 8 << 20


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is that of the next key (rows that repeat a key: by
    text), after the last the first. The edited text has its last
    floor(n_chars / 4) characters replaced by the first as many of the next
    document, or by all of it. Null text counts as empty; null keys come first.

    Documents are dealt out by ranges of the key and sorted; each task compares
    neighbours within its range. Only the last of each range waits: for the
    first of the next range that is not empty.
    """
    spark = docs.sparkSession
    name = docs.schema[key]
    columns = T.StructType([name]).fields + T._parse_datatype_string(OUT).fields
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType()), *columns])

    def table(kind: int, part: int, keys: pa.Array, texts: list | None, rows: list[dict]) -> pa.RecordBatch:
        n = len(keys)
        found = pa.Table.from_pylist([{k: v for k, v in r.items() if k != "key"} for r in rows], schema=_ARROW) if rows else _ARROW.empty_table()
        values = found.combine_chunks().columns if rows else [pa.nulls(n, f.type) for f in _ARROW]
        values = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in values]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts or [None] * n, pa.string()), keys, *values], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for i, j in row_slices(np.concatenate([[0], np.cumsum(sizes)]), COMPARE_CHARS):
                keys, some = batch.column(0).slice(i, j - i), texts[i:j]
                if held is None:
                    yield table(HEAD, part, keys.slice(0, 1), some[:1], [])
                else:
                    keys, some = pa.concat_arrays([held[0], keys]), [held[1], *some]
                if len(some) > 1:
                    yield table(DONE, part, keys.slice(0, len(some) - 1), None, _compare(keys.to_pylist(), some))
                held = keys.slice(len(some) - 1), some[-1]
        if held is not None:
            yield table(PENDING, part, held[0], [held[1]], [])

    # Ranges of the key alone: the bounds are sampled, and samples go through the driver.
    sorted_ = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    found = stage(sorted_.mapInArrow(run, schema), "compared")
    parts = sorted(r[0] for r in found.filter(F.col("kind") == HEAD).select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = found.filter(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = found.filter(F.col("kind") == PENDING).select("part", key, "text").join(after, "part").join(heads, "next_part").select(key, "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compare([None], [a, b])[0] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if rows:
                yield table(DONE, 0, batch.column(0), None, rows)

    done = found.filter(F.col("kind") == DONE).union(last.mapInArrow(finish, schema))
    return done.drop("kind", "part", "text")


_ARROW = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


BANDS, PICKS, AMONG = 24, 6, 64


def band_keys(fingerprint: str) -> list[int]:
    """Keys of the bands of a fingerprint at its own level and the next coarser one.

    A band is the digits at PICKS of the first AMONG places, the same for all
    texts. Texts whose walks are of similar length share one level at least.
    """
    own = int(fingerprint[:2])
    keys = []
    for level in (own, own + 1):
        digits = _at_level(fingerprint, level)
        for band in range(BANDS):
            picks = np.random.Generator(np.random.PCG64(band)).choice(AMONG, PICKS, replace=False)
            picks = np.sort(picks[picks < len(digits)])
            key = np.array([level * BANDS + band + 1], np.uint64)
            for p in picks.tolist():
                key = mix(key * U(0x9E3779B97F4A7C15) + U(int(digits[p]) * AMONG + p))
            keys.append(int(key.view(np.int64)[0]))
    return keys


PIECES, PIECE_BANDS, PIECE_PICKS = (8, 4), 48, 2
SHORT = 256  # texts up to this many characters are also cut into the shorter pieces


def piece_keys(text: str) -> list[int]:
    """Keys of bands of the least hashes of a text's overlapping pieces.

    Scattered edits leave a share of the pieces whole that does not depend on
    the length of the text: at a tenth of the characters about 0.43 of those of
    8 characters. Short texts have too few of them, so they have shorter ones.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keys = []
    for kind, q in enumerate(PIECES):
        if kind and len(chars) > SHORT:
            break
        q_ = min(q, len(chars))
        n = len(chars) - q_ + 1
        least = np.full(PIECE_BANDS * PIECE_PICKS, ~U(0))
        seeds = mix(np.arange(len(least), dtype=np.uint64) + U(0x5851F42D4C957F2D))
        for i in range(0, n, SLICE_CHARS):
            some = chars[i : i + SLICE_CHARS + q_ - 1]
            m = min(SLICE_CHARS, n - i)
            piece = np.full(m, U(q))
            for k in range(q_):
                piece = mix(piece * U(0x9E3779B97F4A7C15) + some[k : k + m])
            for f in range(len(least)):
                least[f] = min(least[f], mix(piece + seeds[f]).min())
        key = np.arange(PIECE_BANDS, dtype=np.uint64) + U(1000 * (kind + 1))
        for pick in least.reshape(PIECE_BANDS, PIECE_PICKS).T:
            key = mix(key * U(0x9E3779B97F4A7C15) + pick)
        keys += key.view(np.int64).tolist()
    return keys


def edit_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most `most`, else None; time and memory of a diagonal band of that width."""
    if abs(len(a) - len(b)) > most:
        return None
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    width, far = 2 * most + 1, len(a) + len(b) + 1
    # Cell d of the row of i characters of a: the distance to i + d - most characters of b.
    shift = np.arange(width) - most
    row = np.where((shift >= 0) & (shift <= len(y)), shift, far)
    for i in range(1, len(x) + 1):
        j = i + shift
        inside = (j >= 1) & (j <= len(y))
        same = np.full(width, False)
        same[inside] = y[j[inside] - 1] == x[i - 1]
        best = np.minimum(row + ~same, np.append(row[1:], far) + 1)
        best = np.where(inside, best, np.where(j == 0, i, far))
        # Insertions run along the row: each cell from the best one to its left.
        row = np.minimum(np.minimum.accumulate(best - shift) + shift, far)
        row = np.where((j >= 0) & (j <= len(y)), row, far)
    found = int(row[len(y) - len(x) + most])
    return found if found <= most else None


def near_texts(queries: DataFrame, docs: DataFrame, most_share: float = 0.1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query, match, distance: for every query text the different texts within an edit distance of most_share of the longer one.

    Texts are candidates if their lengths allow the distance and they share a
    band of their fingerprints or of their pieces; the exact distance decides.
    Equal texts are one text, named by its smallest key, on
    both sides. Null texts and keys are left out. Queries are a stated part of
    the documents, not all of them.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        texts = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias(name), F.col(text).alias("text"))
        firsts = stage(texts.groupBy(F.md5("text").alias("digest")).agg(F.min(name).alias(name)), "texts")
        return texts.withColumn("digest", F.md5("text")).join(firsts, ["digest", name]).dropDuplicates(["digest"]).select(name, "digest", "text")

    def bands(df: DataFrame, name: str) -> DataFrame:
        schema = T.StructType([df.schema[name], T.StructField("digest", T.StringType()), T.StructField("chars", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(2).to_pylist()
                keys = [band_keys(p) + piece_keys(t) for p, t in zip(fingerprints(texts), texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, texts), pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=schema.fieldNames())

        return df.mapInArrow(run, schema).select(F.col(name), F.col("digest").alias(f"{name}_digest"), F.col("chars").alias(f"{name}_chars"), F.explode("keys").alias("band"))

    asked, held = keyed(queries, "query"), keyed(docs, "match")
    pairs = bands(asked, "query").join(bands(held, "match"), "band").filter("query_digest <> match_digest")
    pairs = pairs.filter(F.abs(F.col("query_chars") - F.col("match_chars")) <= F.greatest("query_chars", "match_chars") * most_share).select("query", "match").distinct()
    joined = pairs.join(asked.select("query", F.col("text").alias("a")), "query").join(held.select("match", F.col("text").alias("b")), "match")
    schema = T.StructType([pairs.schema["query"], pairs.schema["match"], T.StructField("distance", T.LongType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edit_distance(a, b, int(most_share * max(len(a), len(b)))) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            result = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=schema.fieldNames())
            yield result.filter(result.column(2).is_valid())

    return joined.select("query", "match", "a", "b").mapInArrow(verify, schema)
