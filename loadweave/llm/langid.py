"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton of sample text recognises exactly the
substrings of the sample. A document is parsed greedily into the longest
phrases that occur in it; a symbol that the sample lacks is a phrase of its own.
With c phrases, c * log2(n) estimates the bits that the document costs in terms
of the language (cross-parsing entropy), n being the symbols of the largest
sample: were it the language's own, a phrase would cost the less the less is
known of the language. The cheapest language wins.

The automata are completed (a symbol that does not continue the phrase ends it
and starts the next), so all blocks of a batch are parsed in step, one symbol
of every block and language at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.columns import releasing, row_slices, text_bytes
from loadweave.llm.pieces import LETTER, char_classes

UNKNOWN = "und"
BLOCK = 4096  # symbols; a phrase ends with its block
SLICE_BYTES = 2 << 20
SYMBOLS = 96  # most frequent letters that get a symbol of their own
GAP, RARE = 0, 1  # anything between letters; letters without a symbol


class Model(NamedTuple):
    """Sample text per language, in the order of the languages' names."""

    languages: tuple[str, ...]
    samples: tuple[str, ...]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def learn(docs: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", chars: int = 30_000, windows: int = 256, window: int = 512, max_languages: int = 500) -> Model:
    """Collects bounded samples of the labelled rows.

    Bounds: about `windows` documents per language, chosen by the hash of their
    key, give one window of `window` characters each at a place that the hash
    decides; of these, `chars` characters are used. More than `max_languages`
    labels are an error. Rows with a null label or text teach nothing, and so does a
    label without a letter in its sample: it is no language that can be predicted.
    """
    labelled = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(71)).alias("h"))
    counts = {r[0]: r[1] for r in labelled.groupBy("label").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model((), ())
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, windows / n))])
    chosen = labelled.filter(F.pmod("h", F.lit(1 << 20)) < share[F.col("label")] * (1 << 20))
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - window + 1, F.lit(1)).cast("long")).cast("int") + 1
    rows = chosen.select("label", "h", F.substring("text", place, F.lit(window)).alias("text")).collect()
    samples = {}
    for name in sorted(counts):
        parts = sorted({(r["h"], r["text"]) for r in rows if r["label"] == name})
        sample = "\n".join(dict.fromkeys(t for _, t in parts))[:chars]
        if (char_classes()[_points(sample)] == LETTER).any():
            samples[name] = sample
    return Model(tuple(samples), tuple(samples.values()))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = moves[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(symbol) == q:
                    moves[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


class Parser:
    """The completed automata of all languages in one table."""

    def __init__(self, model: Model):
        points = [_points(s.lower()) for s in model.samples]
        letters, counts = np.unique(np.concatenate(points), return_counts=True)
        own = char_classes()[letters] == LETTER
        letters = letters[own][np.argsort(-counts[own], kind="stable")][:SYMBOLS]
        self.symbol = np.where(char_classes() == LETTER, np.uint8(RARE), np.uint8(GAP))
        self.symbol[letters] = np.arange(2, 2 + len(letters))
        width = self.width = 2 + len(letters)
        tables, self.starts, sizes, rows = [], [], [], 0
        for p in points:
            symbols, _ = self.squeeze(self.symbol[p], np.array([0, len(p)]))
            moves = suffix_automaton(symbols.tolist())
            # One more state, after a symbol that the sample does not have at all.
            lost = len(moves)
            target = np.full((lost + 1, width), -1, np.int64)
            for state, move in enumerate(moves):
                if move:
                    target[state, list(move)] = list(move.values())
            restart = np.where(target[0] >= 0, target[0], lost)
            ends = target < 0
            ends[0] = False  # state 0 is that of an empty first phrase
            target[0] = restart
            tables.append(((np.where(ends, restart, target) + rows) * width << 1 | ends).astype(np.int64))
            self.starts.append(rows * width)
            sizes.append(len(symbols))
            rows += lost + 1
        self.table = np.concatenate(tables).ravel()
        if self.table[-1] < 1 << 31 and len(self.table) < 1 << 30:
            self.table = self.table.astype(np.int32)
        self.starts, self.bits = np.array(self.starts, self.table.dtype), float(np.log2(max(2, *sizes)))
        # Of equally cheap languages the one with most text wins, then the first name.
        self.order = np.argsort(-np.array(sizes), kind="stable")

    def squeeze(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drops all but one of the gaps in a row, and moves the row offsets along."""
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != GAP) | (symbols[:-1] != GAP)
        moved = np.concatenate([[0], np.cumsum(keep)])[offsets]
        return symbols[keep], moved

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of phrases of each row (down) for each language (across)."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(len(sizes)), blocks)
        first = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(BLOCK, offsets[1:][row] - first)
        order = np.argsort(-size, kind="stable")
        row, first, size = row[order], first[order], size[order]
        found = np.zeros((len(self.starts), len(row)), np.int32)
        state = np.repeat(self.starts[:, None], len(row), axis=1)
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, n in enumerate(active.tolist()):
            if n < state.shape[1]:
                state = np.ascontiguousarray(state[:, :n])
            move = self.table[state + symbols[first[:n] + t]]
            found[:, :n] += move & 1
            state = move >> 1
        total = np.zeros((len(sizes), len(self.starts)), np.int64)
        np.add.at(total, row, found.T + 1)
        return total


@lru_cache(maxsize=1)
def _parser(model: Model) -> Parser:
    return Parser(model)


def predict(docs: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of every whole text and a score from 0 to 1.

    The score is 1 - cost of the best / cost of the second-best language, 1 if
    only one was learned. A null text, one without a letter, or a model without
    languages gives 'und' and 0. Ties go to the language with
    the largest sample, then to the first name. Columns that have
    the new names are replaced; all others pass through, repeated rows too.
    """
    kept = docs.drop(language, score)
    schema = T.StructType([*kept.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])

    def judge(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        best, confidence = np.full(len(texts), -1), np.zeros(len(texts))
        if not model.languages:
            return best, confidence
        parser = _parser(model)
        lower = [t.lower() for t in texts]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))])
        points = _points("".join(lower))
        symbols = parser.symbol[points]
        letters = np.concatenate([[0], np.cumsum(symbols != GAP)])[offsets]
        cost = parser.phrases(*parser.squeeze(symbols, offsets)) * parser.bits
        some = np.diff(letters) > 0
        best[some] = parser.order[cost[some][:, parser.order].argmin(axis=1)]
        if cost.shape[1] == 1:
            confidence[some] = 1.0
        else:
            two = np.partition(cost[some], 1, axis=1)
            confidence[some] = 1 - two[:, 0] / two[:, 1]
        return best, confidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNKNOWN])
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = text_bytes(column)
            for i, j in row_slices(offsets, SLICE_BYTES):
                best, confidence = judge([t or "" for t in column.slice(i, j - i).to_pylist()])
                chosen = names.take(pa.array(np.where(best < 0, len(model.languages), best)))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, chosen, pa.array(confidence)], names=[*batch.schema.names, language, score])

    return kept.mapInArrow(releasing(run), schema)
