"""Near duplicates of texts and vectors, and components, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from loadweave.llm.components import components
from loadweave.llm.dartminhash import near_duplicates, signatures
from loadweave.llm.dartminhash import shared_counts as dartminhash_counts
from loadweave.llm.pqindex import near_vectors
from loadweave.llm.shingles import elements, similarities, word_hashes


class Groups:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def plain_words(text):
    """Runs of letters, marks and digits; a Han, kana or Thai letter is a word."""
    return [w for w in regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+", (text or "").lower(), regex.V1)]


def weights(text):
    words = plain_words(text)
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def similarity(a, b):
    a, b = weights(a), weights(b)
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


TEXTS = ["a b c d e f g", "A b, c d e f", "x y", "", None, "a a a a a a a a a", "a a a a a a a a", "日 本 語 テ ス ト", "one"]


def test_words_of_all_scripts():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é—«中文ไทよ1𝒳한국\u00a0\u3000👍.,", k=rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    found, offsets = word_hashes(pa.array(texts, pa.string()))
    words = [plain_words(t) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    number = {}
    for word, value in zip([w for ws in words for w in ws], found.tolist()):
        assert number.setdefault(word, value) == value
    assert len(set(number.values())) == len(number)


def test_texts_without_blanks_are_near(spark):
    rng = random.Random(5)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(200))
    rows = [(1, han), (2, han[:-1] + "。"), (3, han[100:] + han[:50][::-1]), (4, thai), (5, thai[:-2] + "กข"), (6, f"«{han}»")]
    found = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 1}


def test_similarity_is_weighted_jaccard():
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    found = similarities(pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string()))
    assert found == pytest.approx([similarity(a, b) for a, b in pairs])


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        b = a.copy()
        changed = n // 3
        b[:changed] = rng.integers(1, 2**63, changed).astype(np.uint64)
        s = signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]), 4096)
        assert (s != 0).all()
        assert (s[0] == s[1]).mean() == pytest.approx((n - changed) / (n + changed), abs=0.04)
    values, at = elements(pa.array(TEXTS, pa.string()))
    assert (signatures(values, at, 64)[[3, 4]] == 0).all()


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(500, 500)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(60)]
    rng.shuffle(edges)
    groups = Groups({x for e in edges for x in e})
    for a, b in edges:
        groups.link(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame([e if rng.random() < 0.5 else e[::-1] for e in edges], "a long, b long")).collect()}
    assert found == {x: groups.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(rng.choice([1, 5, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [*TEXTS, "", None, "w1 " * 30_000]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, bucket int")
    groups = Groups(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if texts[a] is not None and (texts[a] == texts[b] or similarity(texts[a], texts[b]) >= 0.8):
                groups.link(a, b)
    found = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in found.items()} == {i: groups.root(i) for i in range(len(texts))}
    assert all(r.kept == (r.class_id == i) for i, r in found.items())


def test_every_pair_of_a_bucket_counts(spark):
    """Texts of one bucket that are like each other but not like the first one still share a class."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(200)]
    first = [rng.choice(words) for _ in range(100)]
    second = first[:83] + [rng.choice(words) for _ in range(17)]
    docs = [first] + [second[: 100 - k] for k in range(3)]
    texts = [" ".join(d) for d in docs]
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=64, rows=1).collect()
    groups = Groups(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if similarity(texts[a], texts[b]) >= 0.8:
                groups.link(a, b)
    assert {r.doc_id: r.class_id for r in found} == {i: groups.root(i) for i in range(len(texts))}


def test_large_mixed_buckets_go_block_by_block(spark, monkeypatch):
    """Chains of texts that each resemble only their neighbours, all in the same buckets."""
    from loadweave.llm import dartminhash

    monkeypatch.setattr(dartminhash, "BLOCK", 4)
    rng = random.Random(12)
    base = [f"u{i}" for i in range(120)]
    texts = []
    for step in range(25):
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 2, 4])):
            base[rng.randrange(60, 120)] = f"n{step}{rng.random()}"
    rng.shuffle(texts)
    groups = Groups(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if similarity(texts[a], texts[b]) >= 0.8:
                groups.link(a, b)
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=48, rows=1).collect()
    assert {r.doc_id: r.class_id for r in found} == {i: groups.root(i) for i in range(len(texts))}


def test_shared_counts_are_intersections():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 3000))).astype(np.uint64) for _ in range(9)]
    found = dartminhash_counts(sets[:4], sets[4:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_odd_tables_of_documents(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, None)]
    found = sorted((r.doc_id, r.class_id) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert found == [(1, 1), (3, 3), (4, 4)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(25, 12))
    x = centers[rng.integers(0, 25, 700)] + 0.25 * rng.normal(size=(700, 12))
    x[10:60] = x[10]
    x[60:70] = 3.5 * x[10]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, 0.0]]
    rows += [(1000 + i, v, None) for i, v in enumerate(odd)] + [rows[3], (2000, [2.0, 0.0], 1)]
    found = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int")).collect()}
    unit = np.array([r[1] for r in rows[:700]], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    groups = Groups(range(700))
    for a, b in zip(*np.nonzero(near)):
        groups.link(int(a), int(b))
    wanted, got = near.sum() - 700, sum(found[i].n_links for i in range(700))
    assert 0.99 * wanted <= got <= wanted
    assert sum(found[i].component_id != groups.root(i) for i in range(700)) <= 7
    for i in range(6):
        assert (found[1000 + i].n_links, found[1000 + i].component_id, found[1000 + i].kept) == (0, 1000 + i, True)
    assert (found[1006].n_links, found[2000].component_id) == (1, 1006)
    assert len(found) == 708


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(5, [1.0, 2.0])], schema)).collect()] == [(5, 0, 5, True)]
