"""Byte-level BPE and packing against the public libraries and exact sums."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loadweave.llm import bpe, packing
from loadweave.llm.columns import HashIndex, row_slices, text_bytes
from loadweave.llm.pieces import PieceIds, piece_starts
from loadweave.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HF = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = regex.compile(public_tokenizers.PATTERN)
ODD = ["", None, "a", " ", "\n\n x", "aaaaaaaaaaaaa", "it's we'll 'tis ''s", "日本語 テスト", "é" * 50, "   x", "<|endoftext|>", "ab" * 4000]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    starts = piece_starts(data, offsets[:-1])
    raw = data.tobytes()
    return [raw[a:z].decode() for a, z in zip(starts, [*starts[1:], len(raw)])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n'strevlmdabX19.,!ß中  \u0085’", max_size=12), max_size=4))
def test_pieces_are_those_of_the_pattern(texts):
    assert split(texts) == [p for t in texts for p in PATTERN.findall(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs", "Cn")), max_size=30), max_size=3))
def test_pieces_join_to_the_text(texts):
    assert "".join(split(texts)) == "".join(texts)


def test_queue_gives_lowest_rank_first():
    queue = bpe.RankQueue(50_000)
    order = random.Random(1).sample(range(50_000), 500)
    for rank in order:
        queue.add(rank, np.array([rank]))
    assert [queue.pop()[0] for _ in order] == sorted(order)
    assert queue.pop() is None


def test_merging_equals_the_library(reference):
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("theandior ") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts.append("".join(rng.choice("abc") for _ in range(20_000)))
    for _, _, ids, counts in bpe.encode_column(pa.array(texts), RANKS):
        wanted = [reference.encode_ordinary(t) for t in texts]
        assert counts.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]


def thue_morse(letters, n):
    """For any constant, a polynomial hash modulo 2**64 gives it and its complement one value from 1,024 letters on."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_pieces_of_one_hash_keep_their_own_ids(reference, monkeypatch):
    texts = [thue_morse(letters, n) for n in (1024, 2048, 4096) for letters in ("ab", "ba", "ab")] + ["word", "drow"]
    wanted = [reference.encode_ordinary(t) for t in texts]
    for shared in (False, True):
        if shared:
            monkeypatch.setattr("loadweave.llm.pieces.hash_runs", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
        for together in (True, False):
            table = PieceIds(bpe.merges(RANKS).encode)
            for part in [texts] if together else [[t] for t in texts]:
                data, offsets = text_bytes(pa.array(part))
                ids, counts = table.rows(data, offsets)
                assert np.split(ids, np.cumsum(counts)[:-1])[-1].tolist() == wanted[texts.index(part[-1])]
                if together:
                    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == wanted


def test_memory_of_pieces_starts_anew(reference):
    table = PieceIds(bpe.merges(RANKS).encode, slots_log2=4, max_bytes=200)
    for k in range(30):
        part = [f"piece{k} and some more {'x' * k}", "and some more"]
        data, offsets = text_bytes(pa.array(part))
        ids, counts = table.rows(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in part]
        assert len(table.bytes) < 400


def test_queries_keep_pieces_of_one_hash_apart(spark, reference, tmp_path):
    texts = [thue_morse("ab", 2048), thue_morse("ba", 2048), thue_morse("ab", 4096), thue_morse("ba", 4096), None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in QUERIES["op6_byte_bpe"].run(spark, str(tmp_path)).collect()}
    own = Tokenizer.from_file(HF)
    pieces = {}
    for r in QUERIES["op2_best_fit_packing"].run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        listed = sorted(pieces[i])
        assert sum(n for _, n, _ in listed) == len(ids)
        assert all(crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n, crc in listed)


def test_encode_and_decode_frames(spark, reference):
    rows = [(i, t, 7, "x") for i, t in enumerate([*ODD, "ab"])] + [(0, "", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    encoded = bpe.encode(docs, RANKS)
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens"]
    found = bpe.decode(encoded, RANKS).collect()
    assert len(found) == len(rows)
    for r in found:
        wanted = reference.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == wanted
        assert r.n_tokens == len(wanted)
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_index_with_many_keys():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 3000).astype(np.uint64))
    index = HashIndex(12)
    index.add(keys, np.arange(len(keys), dtype=np.int32))
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert (index.find(keys + np.uint64(1)) < 0).sum() > 2900


def test_slices_hold_one_row_at_least():
    offsets = np.array([0, 0, 5, 100, 101, 101])
    assert list(row_slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]


def placed(histogram, capacity):
    shares, sequences = packing.plan_packing(histogram, capacity)
    rows, ranks = {}, {}
    for s in shares:
        for k in range(s.times * s.each):
            ranks.setdefault(s.length, set()).add(s.first + k)
            rows.setdefault(s.sequence + k // s.each, []).append((s.offset + s.length * (k % s.each), s.length))
    assert {length: len(r) for length, r in ranks.items()} == histogram
    assert all(r == set(range(len(r))) for r in ranks.values())
    for pieces in rows.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(rows) == sequences
    return sequences


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=30))
def test_plans_are_gapless_and_complete(histogram):
    sequences = placed(histogram, 40)
    assert sequences >= -(-sum(a * b for a, b in histogram.items()) // 40)


def test_exact_complements_fill_rows():
    assert placed({30: 4, 10: 4}, 40) == 4
    assert placed({20: 2, 13: 2, 7: 2}, 40) == 2
    assert placed({22: 1, 9: 1, 5: 1, 4: 1}, 40) == 1
    assert placed({21: 10}, 40) == 10
    assert placed({}, 40) == 0


def test_plan_comes_close_to_the_bound():
    rng = random.Random(5)
    histogram = {}
    for _ in range(50_000):
        length = rng.randint(1, 1024)
        histogram[length] = histogram.get(length, 0) + 1
    assert placed(histogram, 1024) <= 1.01 * sum(a * b for a, b in histogram.items()) / 1024


def test_packed_documents(spark):
    tokenizer = Tokenizer.from_file(HF)
    tokenizer.encode_special_tokens = True
    texts = [*ODD, "word " * 700, "word " * 700, "x y z"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    pieces = packing.token_pieces(docs, HF, 64, 2)
    found = packing.pack(pieces, 64).collect()
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 64)))
        assert all(r.length == 64 for r in mine[1:])
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in mine] == [sum(p.length for p in mine[:k]) for k in range(len(mine))]
    rows = {}
    for r in found:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces_ in rows.values():
        pieces_.sort()
        assert [o for o, _ in pieces_] == [sum(n for _, n in pieces_[:k]) for k in range(len(pieces_))]
        assert sum(n for _, n in pieces_) <= 64
    assert packing.pack(packing.token_pieces(docs.limit(0), HF, 64, 2), 64).count() == 0


def test_digest_of_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = packing.token_pieces(docs, HF, 64, 2).withColumn("crc", F.crc32("ids")).first()
    assert row.crc == zlib.crc32(np.array([*Tokenizer.from_file(HF).encode("some text").ids, 2], "<u4").tobytes())
