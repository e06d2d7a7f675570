"""Whitening against plain eigenvectors in doubles and exact integer sums."""

import math

import numpy as np
import pytest

from loadweave.llm.charpoly import charpoly_modulo, characteristic_polynomial, largest_roots, leading_components, primes_below, roots_above
from loadweave.llm.queries import QUERIES
from loadweave.llm.whitening import integer_codes, limbs, moments, whiten

FOLDER = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, component string, code int"


def brute(rows, components=4):
    """vec_id, x, deviation; n, eigenvalues, unit eigenvectors (down), mean of vectors of one length."""
    kept = [(k, [math.floor(256 * c) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fitted = sorted({tuple(x) for _, x in kept})
    n, total = len(fitted), [sum(c) for c in zip(*fitted)]
    x = np.array(fitted, float)
    e, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1]))
    far = [(k, v, sum((n * c - s) ** 2 for c, s in zip(v, total))) for k, v in kept]
    return far, n, e[::-1][:components], vectors[:, ::-1][:, :components], x.mean(axis=0), e.sum()


def check(found, rows, components=4):
    far, n, e, vectors, mean, trace = brute(rows, components)
    by_key = {}
    for r in found:
        by_key.setdefault((r.vec_id, r.component), []).append(r)
    assert sum(len(x) for x in by_key.values()) == len(far) * len(e)
    signs = {}
    for k, x, deviation in far:
        for c in range(len(e)):
            r = by_key[(k, c + 1)].pop()
            assert (r.n, r.deviation) == (n, deviation)
            wanted = (np.array(x) - mean) @ vectors[:, c] / math.sqrt(e[c])
            if abs(wanted) > 1e-6:
                assert signs.setdefault(c, np.sign(wanted * r.whitened)) == np.sign(wanted * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(wanted), abs=1e-8)
            assert r.explained == pytest.approx(e[c] / trace, rel=1e-9)
            assert r.identity_error < 1e-8


def test_primes_and_polynomials_modulo():
    assert [p for p, _ in zip(primes_below(1 << 31), range(2))] == [2147483647, 2147483629]
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 7):
        a = rng.integers(-5, 6, (d, d)) * (rng.random((d, d)) < 0.6)
        wanted = np.round(np.poly(a)[::-1]).astype(int) % 10007
        assert charpoly_modulo(a, 10007).tolist() == wanted.tolist()


def test_exact_polynomial_and_roots(spark):
    # det(x - diag) = (x - 5)**2 (x - 3) x, moved by an orthogonal integer basis.
    basis = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])
    matrix = (basis @ np.diag([5, 5, 3, 0]) @ basis.T).tolist()
    polynomial = characteristic_polynomial(spark, matrix)
    assert polynomial == [0, -4800, 880, -52, 1]
    assert [roots_above(polynomial, x, 0) for x in (0, 11, 12, 19, 20)] == [3, 3, 2, 2, 0]
    assert [(round(a / 2**b, 9), m) for a, b, m in largest_roots(polynomial, 4)] == [(20, 2), (12, 1)]
    vectors = np.array([c.vector for c in leading_components(spark, matrix, 4)])
    assert len(vectors) == 3
    assert vectors @ vectors.T == pytest.approx(np.eye(3), abs=1e-14)
    assert np.array(matrix) @ vectors.T == pytest.approx(vectors.T * [20, 20, 12], abs=1e-12)


def test_close_roots_are_told_apart(spark):
    # Two eigenvalues that differ by one part in 10**18, far below a double's digits.
    big = 10**18
    components = leading_components(spark, [[big, 1, 0], [1, big, 0], [0, 0, 5]], 2)
    assert [c.numerator >> c.bits for c in components] == [big + 1, big - 1]
    half = math.sqrt(0.5)
    assert abs(components[0].vector) == pytest.approx([half, half, 0], abs=1e-15)
    assert components[0].vector[0] * components[0].vector[1] > 0 > components[1].vector[0] * components[1].vector[1]


def test_moments_are_exact(spark):
    x = np.array([3, -(1 << 20), 1 << 40, -(1 << 62), (1 << 62) - 1, 0], np.int64)
    assert sum(part.astype(np.int64).astype(object) * (1 << 20 * k) for k, part in enumerate(limbs(x))).tolist() == x.tolist()
    rows = [(i, [float(i * 7 - 30), 2.0**45 * (i - 4), -0.5 * i, 1e300]) for i in range(12)]
    codes = integer_codes(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").repartition(3)
    exact = [[min(math.floor(256 * c), 2**63 - 1) for c in v] for _, v in rows]
    n, total, products = moments(codes, 4)
    assert n == 12
    assert total == [sum(c) for c in zip(*exact)]
    assert products == [[sum(v[i] * v[j] for v in exact) for j in range(4)] for i in range(4)]


def test_like_plain_eigenvectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.2] * 0.3 + 0.1).tolist()) for i in range(150)]
    rows += [(500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (501, [float("nan")] * 6), (502, [float("inf")] + [0.0] * 5), (503, None)]
    rows += [(k, rows[3][1]) for k in range(600, 640)] + [rows[5], rows[5], (None, rows[7][1]), (700, [-0.0] * 6)]
    found = whiten(spark.createDataFrame([(k, v, "x", 1) for k, v in rows], VECTORS)).collect()
    assert found[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    check(found, rows)


def test_defined_edges(spark):
    def run(rows):
        return sorted(tuple(r) for r in whiten(spark.createDataFrame([(k, v, "x", 1) for k, v in rows], VECTORS)).collect())

    assert run([]) == run([(1, None), (2, []), (3, [float("nan")])]) == []
    # One distinct vector: nothing varies.
    assert run([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == [(k, c, 1, 0, None, None, 0.0) for k in (1, 2) for c in (1, 2)]
    # Vectors of other lengths have their own list; a component without variance has no value.
    found = run([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0])])
    assert [(k, c, n, d) for k, c, n, d, *_ in found] == [(1, 1, 2, 256**2), (1, 2, 2, 256**2), (2, 1, 2, 256**2), (2, 2, 2, 256**2), (3, 1, 1, 0)]
    assert [abs(w) if w is not None else None for *_, w, _, _ in found] == [1.0, None, 1.0, None, None]
    assert [x for *_, x, _ in found] == [1.0, 0.0, 1.0, 0.0, None]
    # Entries of any size: deviations beyond 64 bits are null.
    assert [r[3] for r in run([(1, [1e300]), (2, [0.0])])] == [None, None]


def test_query_is_whole_and_like_eigenvectors(spark):
    from loadweave.llm.queries import table

    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    check(QUERIES["op11_whitening"].run(spark, FOLDER).collect(), rows)
