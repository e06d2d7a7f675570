"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the
lines next to it, with a transition weight between labels. Training lines take
the label of their document. Forward-backward gives the probability of a good
line; the mean over the lines, weighted by their lengths, is calibrated to the
probability of a good document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.columns import hash_runs, releasing, row_slices, text_bytes

SLICE_BYTES = 2 << 20
UPPER, LOWER, DIGIT, BLANK, POINT, SIGN, INNER = range(7)
OWN = ("upper", "digits", "signs", "points", "word_length", "words", "repeats", "closed", "starts_upper", "signed_words", "short")
FEATURES = tuple(f"{where}_{f}" for where in ("own", "previous", "next") for f in OWN) + ("first", "last", "same_as_previous")


@cache
def _ascii_kinds() -> np.ndarray:
    kinds = np.full(256, LOWER, np.uint8)
    for i in range(128):
        c = chr(i)
        kinds[i] = UPPER if c.isupper() else LOWER if c.islower() else DIGIT if c.isdigit() else BLANK if c.isspace() else POINT if c in ".,;:?!'\"-()" else SIGN
    kinds[0x80:0xC0] = INNER
    return kinds


@cache
def _two_byte_kinds() -> np.ndarray:
    """Kinds of the code points that two bytes encode; longer ones count as lower-case letters."""
    kinds = np.full(0x800, LOWER, np.uint8)
    for i in range(0x80, 0x800):
        group = unicodedata.category(chr(i))
        kinds[i] = {"Lu": UPPER, "Nd": DIGIT, "Zs": BLANK}.get(group, SIGN if group[0] == "S" else POINT if group[0] == "P" else LOWER)
    return kinds


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines of all rows, their lengths in bytes, and the offsets of the rows in lines.

    A row without bytes has no line; a line break at the end opens no further line.
    """
    n = len(data)
    ends_row = np.zeros(n + 1, bool)
    ends_row[offsets[1:]] = True
    break_ = data == 10
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins[1:][break_] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros((0, len(FEATURES))), np.zeros(0), rows
    ends = np.append(starts[1:], n)
    ends = ends - break_[ends - 1]
    lengths = (ends - starts).astype(float)

    kinds = _ascii_kinds()[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(lead):
        point = (data[lead].astype(np.int32) & 0x1F) << 6 | (data[np.minimum(lead + 1, n - 1)] & 0x3F)
        kinds[lead] = _two_byte_kinds()[point]

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), starts).astype(float)

    upper, digits, points, signs = (per_line(kinds == k) for k in (UPPER, DIGIT, POINT, SIGN))
    letters = upper + per_line(kinds == LOWER)
    blank = (kinds == BLANK) | break_
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | begins[1:n]
    word_start = np.flatnonzero(first)
    over = np.zeros(n, bool)
    over[:-1] = word[:-1] & (blank[1:] | begins[1:n])
    over[n - 1] = word[n - 1]
    word_end = np.flatnonzero(over) + 1
    words = per_line(first)
    hashes = hash_runs(data, word_start, word_end)
    line_of_word = np.searchsorted(starts, word_start, "right") - 1
    again = np.zeros(len(word_start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    repeats = np.bincount(line_of_word, again, len(starts))
    signed = np.bincount(line_of_word, kinds[word_end - 1] == SIGN, len(starts)) if len(word_start) else np.zeros(len(starts))
    last_kind = kinds[np.maximum(ends - 1, starts)]

    some = np.maximum(lengths, 1)
    many = np.maximum(words, 1)
    own = np.column_stack([
        upper / np.maximum(letters, 1), digits / some, signs / some, points / some, np.minimum(some / many, 40) / 10,
        np.log1p(words) / 5, repeats / many, last_kind == POINT, kinds[starts] == UPPER, signed / many, words < 4,
    ]).astype(float)
    line_hash = hash_runs(data, starts, ends)
    opens = np.zeros(len(starts) + 1, bool)
    opens[rows] = True
    closes = opens[1:].copy()
    closes[-1] = True
    opens = opens[:-1]
    previous, following = np.zeros_like(own), np.zeros_like(own)
    previous[1:] = own[:-1]
    previous[opens] = 0
    following[:-1] = own[1:]
    following[closes] = 0
    same = np.zeros(len(starts))
    same[1:] = (line_hash[1:] == line_hash[:-1]) & ~opens[1:]
    return np.column_stack([own, previous, following, opens, closes, same]), lengths, rows


class Model(NamedTuple):
    """center, scale, weights: by feature; bias; moves: potentials from label to label; slope and base calibrate."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float
    base: float
    prior: float


def good_lines(odds: np.ndarray, moves: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probability of the label good per line, and per row the expected counts of label pairs (down: from, across: to).

    odds: log of the potential of good against bad per line.
    """
    potential = np.empty((len(odds), 2))
    potential[:, 1] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    potential[:, 0] = 1 - potential[:, 1]
    step = np.exp(moves)
    ahead, behind = potential.copy(), np.ones_like(potential)
    sizes = np.diff(rows)
    order = np.argsort(-sizes, kind="stable")
    first, size = rows[:-1][order], sizes[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left").tolist()
    ahead /= ahead.sum(axis=1, keepdims=True)
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        x = (ahead[at - 1] @ step) * potential[at]
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    for t in range(1, len(active)):
        at = first[: active[t]] + size[: active[t]] - 1 - t
        x = (potential[at + 1] * behind[at + 1]) @ step.T
        behind[at] = x / x.sum(axis=1, keepdims=True)
    both = ahead * behind
    good = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(odds), bool)
    inner[rows[:-1][sizes > 0]] = False
    to = np.flatnonzero(inner)
    pairs = ahead[to - 1][:, :, None] * step * (potential[to] * behind[to])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return good, pairs


def _mean_by_row(values: np.ndarray, lengths: np.ndarray, rows: np.ndarray, empty: float) -> np.ndarray:
    weights = np.concatenate([[0], np.cumsum(lengths + 1)])[rows]
    sums = np.concatenate([[0], np.cumsum(values * (lengths + 1))])[rows]
    total = np.diff(weights)
    return np.where(total > 0, np.diff(sums) / np.maximum(total, 1), empty)


def fit(features: np.ndarray, lengths: np.ndarray, rows: np.ndarray, labels: np.ndarray, rounds: int = 150) -> Model:
    """Maximises the likelihood of the lines' labels by gradient ascent with adaptive steps; deterministic."""
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    k = len(FEATURES)
    if not len(features) or labels.min() == labels.max():
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, np.zeros((2, 2)), 0.0, float(np.log(prior / (1 - prior))), prior)
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.column_stack([(features - center) / scale, np.ones(len(features))])
    sizes = np.diff(rows)
    y = np.repeat(labels, sizes).astype(float)
    # Every document counts alike, and so does every label.
    share = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    weight = np.repeat(share / np.maximum(sizes, 1), sizes) / len(labels)
    inner = np.ones(len(y), bool)
    inner[rows[:-1][sizes > 0]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((len(to), 2, 2))
    seen[np.arange(len(to)), y[to - 1].astype(int), y[to].astype(int)] = 1
    theta = np.zeros(k + 1 + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        good, pairs = good_lines(x @ theta[: k + 1], theta[k + 1 :].reshape(2, 2), rows)
        gradient = np.concatenate([x.T @ (weight * (y - good)), ((seen - pairs) * weight[to][:, None, None]).sum(axis=0).ravel()]) - 1e-4 * theta
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.1 * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.99**r)) + 1e-8)
    moves = theta[k + 1 :].reshape(2, 2)
    good, _ = good_lines(x @ theta[: k + 1], moves, rows)
    logit = _logit(_mean_by_row(good, lengths, rows, prior))
    slope, base = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression with one input, slightly damped
        p = 1 / (1 + np.exp(-np.clip(slope * logit + base, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((labels - p) * logit).sum() - 1e-2 * slope, (labels - p).sum() - 1e-2 * base])
        h = np.array([[(w * logit**2).sum() + 1e-2, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-2]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, base = slope + move[0], base + move[1]
    return Model(center, scale, theta[:k], float(theta[k]), moves, float(slope), float(base), prior)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def learn(labels: DataFrame, docs: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", max_docs: int = 3000, max_lines: int = 60, max_chars: int = 6000) -> Model:
    """Fits the model to labelled documents (label 0 or 1), of which the driver gets a bounded sample.

    labels: key and label; docs: key and text. Bounds: about `max_docs` labels,
    half of each kind where there are enough, chosen by the hash of their key
    (at most twice as many where keys repeat); of a longer text, a stretch of
    `max_chars` characters at a place that the hash decides, and of that at
    most `max_lines` lines. The chosen labels alone, not the documents, are
    sent to all tasks. Null labels and texts teach nothing.
    """
    rows = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key), F.lit(83)).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if not counts:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, max_docs / 2 / n))])
    chosen = rows.filter(F.pmod("h", F.lit(1 << 20)) < share[F.col("y")] * (1 << 20)).limit(2 * max_docs)
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_doc"), F.col(text).alias("text"))
    place = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - max_chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    joined = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_key")).select("y", "h", F.substring("text", place, F.lit(max_chars)).alias("text"))
    found = sorted(joined.limit(2 * max_docs).collect(), key=lambda r: (r["h"], r["y"], r["text"]))
    labels_ = np.array([r["y"] for r in found], float)
    data, offsets = text_bytes(pa.array(["\n".join(r["text"].split("\n")[:max_lines]) for r in found], pa.string()))
    parts = [line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in row_slices(offsets, SLICE_BYTES)]
    if not parts:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(rows_) for _, _, rows_ in parts]))])
    model = fit(np.concatenate([f for f, _, _ in parts]), np.concatenate([n for _, n, _ in parts]), at, labels_)
    # The sample holds the labels in equal parts; all labelled rows do not.
    total = float(np.clip(counts.get(1, 0) / sum(counts.values()), 0.01, 0.99))
    shift = np.log(total / (1 - total)) - np.log(model.prior / (1 - model.prior))
    return model._replace(base=model.base + float(shift), prior=total)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability from 0 to 1 that a document is good, over its whole text.

    A null or empty text gets the share of good documents among the labelled
    rows. A column of that name is replaced; all others pass through.
    """
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for i, j in row_slices(offsets, SLICE_BYTES):
                low = offsets[i]
                features, lengths, rows = line_features(data[low : offsets[j]], offsets[i : j + 1] - low)
                good, _ = good_lines((features - model.center) / model.scale @ model.weights + model.bias, model.moves, rows)
                mean = _mean_by_row(good, lengths, rows, 0.5)
                p = 1 / (1 + np.exp(-np.clip(model.slope * _logit(mean) + model.base, -30, 30)))
                p = np.where(np.diff(rows) > 0, p, model.prior)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(p)], names=[*batch.schema.names, out])

    return kept.mapInArrow(releasing(run), schema)
