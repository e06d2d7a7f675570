"""Hashed shingles of words, as weighted elements, for whole Arrow columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loadweave.llm.columns import U, hash_runs, mix, text_bytes

WORDS = 5
BETWEEN, IN_WORD, A_WORD = range(3)
# Scripts written without blanks between words, by the first words of their characters' names.
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "BOPOMOFO", "YI", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: BETWEEN words, IN_WORD (letters, marks, digits), or A_WORD by itself (letters of unspaced scripts)."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(c := chr(code))[0] in "LMN":
            unspaced = code >= 0x80 and unicodedata.name(c, "").startswith(UNSPACED)
            table[code] = A_WORD if unspaced else IN_WORD
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    table = _classes()
    found = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = (data[lead] & (0x7F >> size).astype(np.uint8)).astype(np.int64)
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
    for k in range(4):
        found[lead[k < size] + k] = table[code[k < size]]
    return found


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words one after the other, and the offsets of the rows in them.

    Words are runs of letters, marks and digits in lower case; in scripts
    written without blanks every letter is a word.
    """
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = byte_classes(data)
    inside = kind != BETWEEN
    cut = np.zeros(n + 1, bool)  # no word reaches over these places
    cut[offsets] = True
    cut[1:n] |= ~inside[:-1]
    alone = kind == A_WORD
    cut[:n] |= alone & (data & 0xC0 != 0x80)
    cut[1:n] |= alone[:-1] & ~alone[1:]
    cut[:n] |= ~inside
    cut[n] = True
    starts, ends = np.flatnonzero(inside & cut[:n]), np.flatnonzero(inside & cut[1:]) + 1
    return hash_runs(data, starts, ends), np.searchsorted(starts, offsets)


def elements(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The weighted shingles of each row as distinct 64-bit elements, and the offsets of the rows in them.

    A shingle that occurs w times has weight w; it stands as w elements, one
    for each unit of its weight, so shares of common elements are shares of
    common weight. A row of fewer words than a shingle has one shingle of all
    its words; a row without a word has none.
    """
    hashes, offsets = word_hashes(column)
    sizes = np.diff(offsets)
    counts = np.where(sizes >= words, sizes - words + 1, (sizes > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    first = offsets[:-1][row] + (np.arange(len(row)) - bounds[:-1][row])
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    length = np.minimum(sizes, words)[row]
    shingle = length.astype(np.uint64) * U(0x9FB21C651E98DF25)
    for k in range(words):
        shingle = np.where(k < length, mix((shingle ^ padded[first + k]) + U(0x2545F4914F6CDD1D)), shingle)
    # Number the repetitions of a shingle within its row.
    tagged = mix(shingle + row.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(tagged, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = tagged[order[1:]] == tagged[order[:-1]]
    if same.any():
        index = np.arange(len(order))
        repetition = index - np.maximum.accumulate(np.where(same, 0, index))
        again = order[same]
        shingle[again] = mix(shingle[again] + repetition[same].astype(np.uint64) * U(0xDA942042E4DD58B5))
    return shingle, bounds


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of two columns, row by row; 0 where a side has none."""
    a, at_a = elements(left)
    b, at_b = elements(right)
    n = len(at_a) - 1
    tag = seeds = np.arange(n, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    both = np.concatenate([mix(a + np.repeat(tag, np.diff(at_a))), mix(b + np.repeat(seeds, np.diff(at_b)))])
    row = np.concatenate([np.repeat(np.arange(n), np.diff(at_a)), np.repeat(np.arange(n), np.diff(at_b))])
    order = np.argsort(both)
    common = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    shared = np.bincount(row[order[common]], minlength=n)
    total = np.diff(at_a) + np.diff(at_b) - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 0.0)
