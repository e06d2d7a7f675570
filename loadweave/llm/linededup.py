"""Removes passages whose sentences or lines occurred before, in the same or in any other document.

A unit is a sentence within a line: it ends with its line or with a full stop,
question or exclamation mark, so a line or paragraph is a run of whole units. Units
are compared by a 128-bit digest of their words. Occurrences rank by document key,
then by place; the first stays. Units that occurred before go if they stand in a run
of such neighbours (across lines, units without a word aside) with at least `min_words`
words: a long repeated sentence by itself, short ones only within a repeated passage.
A chance repeat of a short sentence or menu line stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.columns import releasing, row_slices, text_bytes
from loadweave.session import stage

MIN_WORDS = 30
SLICE_BYTES = 4 << 20

_UNIT = re.compile(r"[^\n.!?…。！？]*[.!?…。！？]+|[^\n.!?…。！？]+")
_MARKS = " \t\r\f\v\u00a0\u3000.!?…。！？"
# Scripts written without blanks: Thai to Myanmar, Khmer, kana, Han. Each of their characters is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
# Blanks that are not single spaces or line breaks.
_OTHER_BLANKS = re.compile(r"[^\S \n]|  ")
_WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")


def sliced(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE_BYTES of text, one row at least."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for i, j in row_slices(offsets, SLICE_BYTES):
            yield batch.slice(i, j - i)


def units(text: str) -> Iterator[tuple[re.Match, str, int]]:
    """Place, normalised words and number of words of every unit that has a word.

    Words are in lower case, with single blanks between them; the marks that end the
    unit are no part of them.
    """
    unspaced = not text.isascii() and _HAS_UNSPACED.search(text)
    single = not unspaced and not _OTHER_BLANKS.search(text)
    for found in _UNIT.finditer(text):
        key = found.group().strip(_MARKS).lower()
        if not single:
            key = " ".join(_WORD.findall(key) if unspaced else key.split())
        if key:
            yield found, key, key.count(" ") + 1


def unit_digests(docs: DataFrame) -> DataFrame:
    """id, unit, digest of the first occurrence of every unit within its document; docs: id and text."""
    schema = T.StructType([docs.schema["id"], T.StructField("unit", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(unit, pa.int32()), pa.array(digests, pa.binary())], names=["id", "unit", "digest"])

        for batch in sliced(batches, "text"):
            row, unit, digests = [], [], []
            for r, text in enumerate(batch.column(1)):
                seen = set()
                for u, (_, key, _) in enumerate(units(text.as_py() or "")):
                    if key not in seen:
                        seen.add(key)
                        row.append(r)
                        unit.append(u)
                        digests.append(hashlib.blake2b(key.encode(), digest_size=16).digest())
                    if len(row) > 50_000:
                        yield block()
                        row, unit, digests = [], [], []
            yield block()

    return docs.select("id", "text").mapInArrow(releasing(run), schema)


def repeated_spans(text: str, elsewhere: set[int], min_words: int) -> list[tuple[int, int]]:
    """The spans to cut out of a text. elsewhere: units that occurred in an earlier document.

    A span that takes whole lines takes the line break after them, or the one before
    at the end of the text.
    """
    spans: list[tuple[int, int]] = []
    seen: set[str] = set()
    start = end = size = 0

    def close() -> None:
        if size >= max(min_words, 1):
            a, z = start, end
            if (a == 0 or text[a - 1] == "\n") and (z == len(text) or text[z] == "\n"):
                if z < len(text):
                    z += 1
                elif a > (spans[-1][1] if spans else 0):
                    a -= 1
            spans.append((a, z))

    for u, (place, key, words) in enumerate(units(text)):
        if u in elsewhere or key in seen:
            if not size:
                start = place.start() + len(place.group()) - len(place.group().lstrip())
            end, size = place.start() + len(place.group().rstrip()), size + words
        elif size:
            close()
            size = 0
        seen.add(key)
    close()
    return spans


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "removed") -> DataFrame:
    """docs with repeated passages taken out of the text, and where they were.

    removed: array of (start, end), what was cut out of the original text, in
    characters and in order; the text without these spans is the one returned. A null
    text stays null. Rows with a null key pass through untouched and count for nothing.
    Rows that repeat a key rank by the hash of their text; rows equal in key and text
    are one document, and take nothing from each other. A document of which nothing is
    left gets an empty text. A column named as `removed` is replaced; all others pass
    through. Scripts without blanks count each character as a word.
    """
    kept = docs.drop(removed)
    # The text's hash beside the key: rows that share a key lose passages of their own only.
    own = F.xxhash64(F.col(text))
    found = unit_digests(docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.struct(F.col(key).alias("key"), own.alias("own")).alias("id"), F.col(text).alias("text")))
    first = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    # Stored, so that the join below shuffles both sides anew and Spark can split a very common unit.
    first = stage(first, "repeated")
    drop = found.join(first, "digest").filter("id > first").groupBy("id").agg(F.collect_set("unit").alias("_units"))

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField(removed, span)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            at = batch.schema.get_field_index(text)
            keyed = batch.column(batch.num_columns - 1).to_pylist()
            texts, spans = [], []
            for value, (has_key, elsewhere) in zip(batch.column(at), ((k["keyed"], k["units"]) for k in keyed)):
                value = value.as_py()
                gone = repeated_spans(value, set(elsewhere or ()), min_words) if value is not None and has_key else []
                if gone:
                    bounds = [0, *(x for s in gone for x in s), len(value)]
                    value = "".join(value[a:z] for a, z in zip(bounds[::2], bounds[1::2]))
                texts.append(value)
                spans.append([{"start": a, "end": z} for a, z in gone])
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*batch.schema.names[:-1], removed])

    drop = drop.select(F.col("id.key").alias("_key"), F.col("id.own").alias("_own"), "_units")
    joined = kept.join(drop, (kept[key] == drop["_key"]) & (F.xxhash64(kept[text]) == drop["_own"]), "left")
    told = F.struct(kept[key].isNotNull().alias("keyed"), F.col("_units").alias("units")).alias("_units")
    return joined.select(*[kept[c] for c in kept.columns], told).mapInArrow(releasing(cut), schema)
