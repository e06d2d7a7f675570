"""Benchmark passages in documents against brute force over words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loadweave.llm import decontaminate
from loadweave.llm.decontaminate import find_items
from loadweave.llm.queries import QUERIES
from tests.compare import differences, open_tables

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, items string, n_words int"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(text, items, width=10):
    own = words(text)
    plain = [w for w, _, _ in own]
    hit, found = set(), set()
    for key, item in items:
        pattern = [w for w, _, _ in words(item)]
        size = min(width, len(pattern))
        for k in range(len(pattern) - size + 1 if size else 0):
            for at in range(len(plain) - size + 1):
                if plain[at : at + size] == pattern[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(key)
    spans = []
    for k in sorted(hit):
        if k - 1 in hit:
            spans[-1] = (spans[-1][0], own[k][2])
        else:
            spans.append((own[k][1], own[k][2]))
    return len(plain), len(hit), found, spans


def cases():
    rng = random.Random(5)
    some = ["the", "Cat", "sät", "öl", "x1", "日本", "no", "É", "a", "k9"]
    passage = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items = [(i, passage(rng.choice([3, 9, 10, 14, 25]))) for i in range(30)] + [(40, None), (41, ""), (42, "?!"), (30, "zebra"), (31, "zebra quark"), (3, "another text under key three"), (50, passage(12)), (51, None)]
    items.append((60, items[-3][1]))
    docs = []
    for i in range(60):
        parts = [passage(rng.randrange(0, 30)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randrange(3), re.sub(" ", lambda _: rng.choice([" ", " - ", "\n", ".. "]), (rng.choice(items)[1] or "").upper()))
        docs.append((i, rng.choice(["", "é! ", " "]) + " ".join(parts), "x", 7))
    docs += [(100, None, None, None), (101, "", "", 0), (102, "zebra quark zebra", "", 0), (102, "zebra quark zebra", "", 0), (None, "a zebra", "", 0), (103, "zebra " * 30_000 + "quark", "", 0)]
    return docs, items


@pytest.mark.parametrize("part", [2 << 20, 4000])
def test_like_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    docs, items = cases()
    found = find_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    got = sorted(((r.doc_id is None, r.doc_id), r.n_words, r.n_hit, sorted(r["items"]), [tuple(s) for s in r.spans]) for r in found.collect())
    wanted = []
    for key, text, *_ in docs:
        if key == 103:
            wanted.append(((False, key), 30_001, 30_001, [30, 31], [(0, 6 * 30_000 + 5)]))
            continue
        n, hit, keys, spans = brute(text, items)
        wanted.append(((key is None, key), n, hit, sorted(keys), spans))
    assert got == sorted(wanted)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r) for r in find_items(docs, items).collect()] == [(1, 2, 0, [], [])]
    assert find_items(docs.limit(0), spark.createDataFrame([("q", "a")], "item_id string, text string")).count() == 0
    assert find_items(docs, spark.createDataFrame([("q", "B")], "item_id string, text string")).select(F.col("items")[0]).first()[0] == "q"


def test_query_matches_sql(spark):
    query = QUERIES["op12_decontamination"]
    assert differences(query.run(spark, FOLDER), open_tables(FOLDER), query.sql) == []
    assert query.run(spark, FOLDER).filter("contaminated").count() > 0
