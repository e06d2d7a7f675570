"""Hard negatives and the tree's exact elimination against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.llm import hyperplanetree
from loadweave.llm.hyperplanetree import Search, annulus, codes, descend, grow, hard_negatives, surviving
from loadweave.llm.queries import QUERIES
from tests.compare import differences, open_tables

FOLDER = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int, rank string, id int"


def brute(rows, is_anchor, positives=5, negatives=10, shares=(30, 90)):
    usable = {(k, lab, tuple(math.floor(256 * c) for c in v)) for k, v, lab in rows if None not in (k, v, lab) and all(c is not None and math.isfinite(c) and abs(c) < 2**18 for c in v)}
    found = []
    for anchor in [r for r in usable if is_anchor(r[0])]:
        scored = [(-sum(a * b for a, b in zip(anchor[2], x)), k, lab) for k, lab, x in usable if len(x) == len(anchor[2]) and (k, lab, x) != anchor]
        for p, positive, _ in sorted(s for s in scored if s[2] == anchor[1])[:positives]:
            fits = sorted((s, k) for s, k, lab in scored if lab != anchor[1] and shares[0] * -p <= 100 * -s <= shares[1] * -p)[:negatives]
            found += [(anchor[0], positive, rank, k, -p, -s) for rank, (s, k) in enumerate(fits, 1)]
    return sorted(found)


def run(spark, rows, is_anchor=lambda k: k % 10 == 0, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    found = hard_negatives(df, is_anchor, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def clustered(n, dimensions=8, seed=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dimensions))
    group = rng.integers(0, 6, n)
    x = centers[group] + 0.4 * rng.normal(size=(n, dimensions))
    return [(i, (v / np.linalg.norm(v)).tolist(), int(g) % 4) for i, (v, g) in enumerate(zip(x, group))]


@pytest.mark.parametrize("block", [4096, 16])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hyperplanetree, "BLOCK", block)
    rows = clustered(500)
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(60)] + [rows[10], rows[10]]
    rows += [(2000, None, 1), (2010, [1.0, None] * 4, 1), (2020, [float("nan")] * 8, 1), (2030, rows[3][1], None), (None, rows[3][1], 1), (2040, [float("inf")] * 8, 2), (2050, [2.0**18] * 8, 2)]
    rows += [(10, rows[40][1], 0), (10, rows[41][1], rows[10][2]), (2060, [0.0] * 8, 1), (3000, [1.0, 2.0], 1), (3001, [1.0, 1.0], 1), (3002, [0.5, 0.5], 2), (3010, [], 1), (3011, [], 1), (3012, [], 2)]
    assert run(spark, rows) == brute(rows, lambda k: k % 10 == 0)


def test_large_entries_and_other_parameters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=5) * rng.choice([1e-4, 1.0, 2.0**16])).tolist(), i % 3) for i in range(150)]
    rows = [r for r in rows if max(map(abs, r[1])) < 2**18]
    got = run(spark, rows, lambda k: k % 3 == 1, positives=2, negatives=3, shares=(-20, 70))
    assert got == brute(rows, lambda k: k % 3 == 1, 2, 3, (-20, 70))
    assert max(r[4] for r in got) > 2**45


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5], 1)]) == [(0, 1, 1, 2, 65536, 32768)]


def test_subtrees_are_passed_over_but_none_that_holds_a_match(spark):
    rows = clustered(4000, seed=9)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    nodes = codes(df, "vec_id", "embedding", "label").select(F.col("id").alias("node"), "label", "x", F.array("id").alias("ids"))
    search = Search(nodes, 8, leaf_rows=40)
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64)
    assert sorted(r.node for r in search.placed.collect()) == list(range(4000))
    leaf = {r.node: r.leaf for r in search.placed.collect()}
    assert search.tree.leaves > 50
    visited = []
    for q in range(0, 4000, 100):
        scores = x @ x[q]
        for low, high in ((40_000, 45_000), (-hyperplanetree.ENDLESS, hyperplanetree.ENDLESS), (60_000, hyperplanetree.ENDLESS)):
            found = {name for _, name in surviving(search.tree, x[q], *annulus(search.tree, x[q], low, high))}
            assert {leaf[i] for i in np.flatnonzero((scores >= low) & (scores <= high))} <= found
            visited.append((low, len(found) / search.tree.leaves))
    assert np.mean([share for low, share in visited if low == 60_000]) < 0.3


def test_tree_puts_every_vector_in_one_leaf():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(-5, 6, (300, 3)), axis=0)
    tree = grow(x, float(np.sqrt((x**2).sum(axis=1).max())), 8, fanout=4)
    assert set(descend(tree, x).tolist()) == set(range(tree.leaves))
    assert grow(x[:1], 1.0, 8).leaves == 1


def test_query_matches_sql(spark):
    query = QUERIES["op13_hard_negatives"]
    assert differences(query.run(spark, FOLDER), open_tables(FOLDER), query.sql) == []
    assert query.run(spark, FOLDER).count() > 0
