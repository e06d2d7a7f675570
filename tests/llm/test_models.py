"""Language identification and line quality: held-out accuracy, brute force of the parts, odd input."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadweave.llm import langid, linequality
from loadweave.llm.columns import text_bytes

ODD = [None, "", "123 !?", "\n\n", "x", "É", "a\n" * 3000, "日本語"]


def phrases(sample, text):
    """Greedy cross-parsing with plain substring search."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        if text[at] not in sample:
            size = 1
        count += 1
        at += size
    return count


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", min_size=1, max_size=60), st.text("abcd ", max_size=80))
def test_phrases_are_longest_matches(sample, text):
    model = langid.Model(("one", "two"), (sample, "abcd " * 2))
    parser = langid.Parser(model)

    def squeezed(s):
        out = ""
        for c in s:
            if c != " " or not out.endswith(" "):
                out += c
        return out

    symbols, offsets = parser.squeeze(parser.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.array([0, len(text)]))
    found = parser.phrases(symbols, offsets)[0]
    if text:
        assert found.tolist() == [phrases(squeezed(s), squeezed(text)) for s in model.samples]


@given(st.lists(st.integers(0, 2), max_size=25))
def test_automaton_accepts_exactly_the_substrings(symbols):
    moves = langid.suffix_automaton(symbols)
    inside = {tuple(symbols[i:j]) for i in range(len(symbols) + 1) for j in range(i, len(symbols) + 1)}
    for word in itertools.chain.from_iterable(itertools.product(range(3), repeat=k) for k in range(4)):
        state = 0
        for s in word:
            state = moves[state].get(s) if state is not None else None
        assert (state is not None) == (word in inside)


def babble(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_labels_with_little_text_take_nothing_from_the_others(spark):
    rng = random.Random(2)
    alphabets = {"aa": ["ka", "to", "mi", "re"], "bb": ["ch", "ul", "est", "wo"], "cc": ["éa", "ño", "qu", "ix"]}
    rows = [(i, babble(rng, alphabets[name], rng.randint(3, 200)), name) for i, name in enumerate(rng.choices(list(alphabets), k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = docs.filter("doc_id % 3 <> 0")
    asked = docs.filter("doc_id % 3 = 0").select("doc_id", "text")
    wanted = {r.doc_id: r.lang_pred for r in langid.predict(asked, langid.learn(taught)).collect()}
    assert all(wanted[i] == name for i, _, name in rows if i in wanted)
    for small in ["x", "k", "kato mireto", babble(rng, alphabets["aa"], 22)[:100], babble(rng, alphabets["aa"] + alphabets["bb"], 220)[:1000]]:
        for name in ("00", "zz"):
            model = langid.learn(taught.union(spark.createDataFrame([(5001, small, name)], docs.schema)))
            assert name in model.languages
            assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == wanted
    letterless = spark.createDataFrame([(5001, "", "00"), (5004, " 12 !?", "00"), (5005, None, "11"), (5007, "日本", "zz")], docs.schema)
    assert langid.learn(taught.union(letterless)).languages == ("aa", "bb", "cc", "zz")
    assert langid.learn(letterless.filter("lang = '00'")).languages == ()


def test_languages(spark):
    rng = random.Random(1)
    alphabets = {"aa": ["ka", "to", "mi", "re"], "bb": ["ch", "ul", "est", "wo"], "cc": ["éa", "ño", "qu", "ix"]}
    rows = [(i, babble(rng, alphabets[name], rng.randint(3, 60)), name) for i, name in enumerate(rng.choices(list(alphabets), k=300))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "kato", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs.filter("doc_id % 3 <> 0 OR doc_id >= 900"))
    assert model.languages == ("aa", "bb", "cc")
    asked = spark.createDataFrame([*rows, *[(1000 + i, t, "score") for i, t in enumerate(ODD)], rows[0]], "doc_id long, text string, score string")
    found = langid.predict(asked, model).collect()
    assert len(found) == len(rows) + len(ODD) + 1
    held = [r for r in found if r.doc_id < 900 and r.doc_id % 3 == 0]
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id - 1000: r for r in found if r.doc_id >= 1000}
    assert [odd[i].lang_pred for i in range(4)] == ["und"] * 4
    assert all(odd[i].lang_pred in model.languages for i in range(4, 8))
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"}
    assert langid.predict(asked.limit(0), model).count() == 0
    one = langid.learn(docs.filter("lang = 'aa'"))
    assert {r.score for r in langid.predict(asked.limit(5), one).collect()} == {1.0}


def test_too_many_languages(spark):
    docs = spark.range(30).selectExpr("id AS doc_id", "'text' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        langid.learn(docs, max_languages=10)


def brute_marginals(odds, moves):
    n = len(odds)
    total, good = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(o * y for o, y in zip(odds, labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    return good / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 0, 7, 2]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    odds, moves = rng.normal(size=rows[-1]) * 2, rng.normal(size=(2, 2))
    found, pairs = linequality.good_lines(odds, moves, rows)
    wanted = np.concatenate([brute_marginals(odds[a:z], moves) for a, z in zip(rows, rows[1:]) if z > a])
    assert found == pytest.approx(wanted)
    assert pairs.sum(axis=(1, 2)) == pytest.approx(np.ones(len(pairs)))


def test_features_of_lines():
    texts = ["Ab cd.\nab ab ab\n\nX# 12", "", None, "é É", "one\n"]
    features, lengths, rows = linequality.line_features(*text_bytes(pa.array(texts)))
    assert rows.tolist() == [0, 4, 4, 4, 5, 6]
    assert lengths.tolist() == [6, 8, 0, 5, 5, 3]
    at = {name: i for i, name in enumerate(linequality.FEATURES)}
    assert features[:, at["own_upper"]] == pytest.approx([1 / 4, 0, 0, 1, 1 / 2, 0])
    assert features[:, at["own_repeats"]] == pytest.approx([0, 2 / 3, 0, 0, 0, 0])
    assert features[:, at["own_signed_words"]] == pytest.approx([0, 0, 0, 1 / 2, 0, 0])
    assert features[:, at["first"]].tolist() == [1, 0, 0, 0, 1, 1]
    assert features[:, at["last"]].tolist() == [0, 0, 0, 1, 1, 1]
    assert features[1, at["previous_upper"]] == pytest.approx(1 / 4)
    assert features[4, at["previous_upper"]] == 0


def test_quality(spark):
    rng = random.Random(2)

    def line(good):
        words = babble(rng, ["ka", "to", "mi"], rng.randint(4, 12))
        return words.capitalize() + "." if good else words.upper().replace(" ", "!! ")

    rows = [(i, "\n".join(line(y or rng.random() < 0.2) for _ in range(rng.randint(1, 8))), y) for i, y in enumerate(rng.choices([0, 1], [1, 3], k=400))]
    docs = spark.createDataFrame([*rows, (800, None, 1), (801, "text", None)], "doc_id long, text string, quality int")
    model = linequality.learn(docs.filter("doc_id % 4 <> 2").drop("text"), docs)
    asked = spark.createDataFrame([*rows, *[(1000 + i, t, 0) for i, t in enumerate(ODD)], rows[1]], "doc_id long, text string, score int")
    found = linequality.score(asked, model).collect()
    assert len(found) == len(rows) + len(ODD) + 1
    held = [r for r in found if r.doc_id < 400 and r.doc_id % 4 == 2]
    assert sum((r.score >= 0.7) == (rows[r.doc_id][2] == 1) for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1000, 1001)} == {model.prior}
    nothing = linequality.learn(docs.limit(0), docs)
    assert {r.score for r in linequality.score(asked, nothing).collect()} == {0.5}
    assert linequality.score(asked.limit(0), model).count() == 0
