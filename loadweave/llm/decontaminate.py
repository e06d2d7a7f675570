"""Finds passages of test questions and answers in documents with one Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, then runs of ASCII letters and
digits and of all non-ASCII characters. The patterns of the automaton are the
windows of `width` consecutive words of every item, or all words of an item that
has fewer. Documents are normalised as bytes, many at once, and scanned once; the
place of every kept byte leads back to the original text.

The items of one automaton are bounded in size (PART_BYTES of patterns). More items
are dealt over several automata, and each scans the documents; their finds are
merged by document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loadweave.llm.columns import releasing, row_slices, text_bytes
from loadweave.session import stage

WIDTH = 10
PART_BYTES = 2 << 20  # bytes of patterns in one automaton; a byte is about one state
SLICE_BYTES = 1 << 20
MATCHES = 1 << 20  # taken from the automaton at a time
BLANK, BREAK = 0x20, 0x0A

# What each byte becomes: a letter, digit or byte of a non-ASCII character stays, A-Z goes to lower case, the rest is blank.
_BYTES = np.full(256, BLANK, np.uint8)
for _range in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _BYTES[list(_range)] = list(_range)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)

# Runs of hit words: numbers of the words and characters of the original, from and up to.
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")]))


class Words(NamedTuple):
    """Normalised rows, one after the other: b' word word \\n' each.

    place: the byte of the original that each byte of `data` comes from;
    starts, ends: of every word in `data`; rows: offsets of the rows in the words.
    """

    data: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def normalise(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: the UTF-8 bytes of all rows; offsets: of the rows in it."""
    n, rows = len(data), len(offsets) - 1
    mapped = _BYTES[data]
    inside = mapped != BLANK
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    begins, closes = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | row[1:n]
        closes[:-1] &= ~inside[1:] | row[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    bounds = np.searchsorted(first, offsets)
    kept = np.flatnonzero(inside)
    # A blank before every word, a blank and a break after every row.
    word = np.cumsum(begins)[kept] if n else np.zeros(0, np.int64)
    row_of_word = np.repeat(np.arange(rows), np.diff(bounds))
    moved = np.arange(len(kept)) + word + 2 * row_of_word[word - 1] if len(kept) else np.zeros(0, np.int64)
    out = np.full(len(kept) + len(first) + 2 * rows, BLANK, np.uint8)
    place = np.zeros(len(out), np.int64)
    out[moved] = mapped[kept]
    place[moved] = kept
    lengths = last - first
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1] + np.arange(1, len(first) + 1) + 2 * row_of_word
    size = np.zeros(rows, np.int64)
    np.add.at(size, row_of_word, lengths + 1)
    out[np.cumsum(size + 2) - 1] = BREAK
    return Words(out, place, starts, starts + lengths, bounds)


def item_windows(text: str | None, width: int = WIDTH) -> list[str]:
    """The patterns of an item: each window as ' word word ', its UTF-8 bytes as Latin-1 characters."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = normalise(raw, np.array([0, len(raw)]))
    if not len(w.starts):
        return []
    whole = w.data.tobytes().decode("latin-1")
    count = max(1, len(w.starts) - width + 1)
    return [whole[w.starts[k] - 1 : w.ends[min(k + width, len(w.starts)) - 1] + 1] for k in range(count)]


class Automaton(NamedTuple):
    """scan: pattern to its number; sizes: words of each pattern; items: item numbers of each pattern."""

    scan: ahocorasick.Automaton
    sizes: np.ndarray
    items: list[list[int]]


def build(items: list[tuple[object, str]], width: int) -> Automaton:
    numbers: dict[str, int] = {}
    found: list[list[int]] = []
    for i, (_, text) in enumerate(items):
        for window in dict.fromkeys(item_windows(text, width)):
            number = numbers.setdefault(window, len(numbers))
            if number == len(found):
                found.append([])
            found[number].append(i)
    scan = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for window, number in numbers.items():
        scan.add_word(window, number)
    scan.make_automaton()
    return Automaton(scan, np.array([w.count(" ") - 1 for w in numbers], np.int64), found)


class _Part:
    """Items of one automaton under a name, so that a worker builds the automaton once for all its tasks."""

    def __init__(self, items: Broadcast, name: str, width: int):
        self.items, self.name, self.width = items, name, width

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Part) and self.name == other.name


@lru_cache(maxsize=1)
def _automaton(part: _Part) -> Automaton:
    return build(part.items.value, part.width)


def _parts(items: DataFrame, item_key: str, item_text: str, width: int) -> Iterator[list[tuple[object, str]]]:
    """The items in lists of at most PART_BYTES of patterns, one item at least; one list after the other reaches the driver.

    A window is at most `width` words of an item, so its windows hold at most
    `width` times its bytes and blanks.
    """
    rows = items.filter(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).distinct()
    part, size = [], 0
    for item, text in rows.sort("item", "text").toLocalIterator():
        cost = (len(text.encode()) + 2) * width
        if part and size + cost > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((item, text))
        size += cost
    if part:
        yield part


def scan(docs: DataFrame, items: list[tuple[object, str]], item_type: T.DataType, width: int) -> DataFrame:
    """key, n_words, n_hit, items, runs of every row of docs (key, text) against the items of one automaton."""
    part = _Part(docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex, width)
    schema = T.StructType([docs.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("runs", RUNS)])
    listed = to_arrow_type(T.ArrayType(item_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(part)
        names = [name for name, _ in part.items.value]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets, SLICE_BYTES):
                n_words, n_hit, numbers, runs = _judge(automaton, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = pa.array([list(dict.fromkeys(names[n] for n in x)) for x in numbers], listed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), found, runs], names=schema.names)

    return docs.select("key", "text").mapInArrow(releasing(run), schema)


def _judge(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]], pa.Array]:
    """Words, hit words, numbers of found items, and runs of hit words of every row."""
    rows = len(offsets) - 1
    w = normalise(data, offsets)
    n_words = np.diff(w.rows)
    change = np.zeros(len(w.starts) + 1, np.int64)
    pairs = []
    matches = automaton.scan.iter(w.data.tobytes().decode("latin-1")) if automaton.items else iter(())
    while len(some := np.fromiter(chain.from_iterable(islice(matches, MATCHES)), np.int64)):
        ends, patterns = some[::2], some[1::2]
        last = np.searchsorted(w.ends, ends)  # a match ends with the blank after its last word
        np.add.at(change, last - automaton.sizes[patterns] + 1, 1)
        np.add.at(change, last + 1, -1)
        row = np.searchsorted(w.rows, last, "right") - 1
        pairs.append(np.unique(row * len(automaton.items) + patterns))
    items: list[list[int]] = [[] for _ in range(rows)]
    for pair in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
        items[pair // len(automaton.items)].extend(automaton.items[pair % len(automaton.items)])
    hit = np.cumsum(change)[:-1] > 0
    row_of_word = np.repeat(np.arange(rows), n_words)
    edge = np.zeros(len(hit), bool)
    edge[w.rows[:-1][n_words > 0]] = True
    begin, close = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | edge[1:]
    close[:-1] &= ~hit[1:] | edge[1:]
    begin, close = np.flatnonzero(begin), np.flatnonzero(close)
    row = row_of_word[begin]
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = characters[offsets[:-1]][row]
    fields = {
        "first": begin - w.rows[:-1][row],
        "last": close + 1 - w.rows[:-1][row],
        "start": characters[w.place[w.starts[begin]]] - base,
        "end": characters[w.place[w.ends[close] - 1] + 1] - base,
    }
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in fields.values()], names=list(fields))
    return n_words, np.bincount(row_of_word[hit], minlength=rows), items, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)


def _merged(runs: str) -> Column:
    """The union of runs of words; those that touch or overlap become one."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (run["first"] <= last["last"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), add)


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_words, n_hit, items, spans of every row of docs.

    n_words: words of the text; n_hit: those inside an occurrence of a window of an
    item; items: distinct keys of items with an occurring window; spans: the runs of
    hit words as (start, end) in characters of the original text (runs of neighbouring
    hit words are one).

    A null or empty text has no words. Items with a null key or text, or without a
    word, match nothing; items that repeat a key count as one key. Null document keys
    and repeated rows stay, row by row. Other columns are left out, so none can clash.
    An empty table of items finds nothing; one of documents gives no rows.
    """
    item_type = items.schema[item_key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = _parts(items, item_key, item_text, width)
    first = next(parts, [])
    second = next(parts, None)
    if second is None:
        found = scan(rows, first, item_type, width)
    else:
        # More items than one automaton takes: each scans the numbered rows, and what they find meets by row.
        numbered = stage(rows.select(F.struct(F.monotonically_increasing_id().alias("row"), "key").alias("key"), "text"), "documents")
        every = None
        for part in chain([first, second], parts):
            one = stage(scan(numbered, part, item_type, width), "scan")
            # All rows go on from the first automaton, those with a find from the others: one per row and automaton.
            every = one if every is None else every.union(one.filter("n_hit > 0"))
        by_row = every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
        union = by_row.select("key.key", "n_words", F.array_distinct("items").alias("items"), _merged("runs").alias("runs"))
        hits = F.aggregate("runs", F.lit(0).cast("long"), lambda n, run: n + run["last"] - run["first"])
        found = union.select("key", "n_words", hits.alias("n_hit"), "items", "runs")
    spans = F.transform("runs", lambda run: F.struct(run["start"].alias("start"), run["end"].alias("end")))
    return found.select(F.col("key").alias(key), "n_words", "n_hit", "items", spans.alias("spans"))
