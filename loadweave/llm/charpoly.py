"""Eigenvalues and eigenvectors of a symmetric integer matrix without rounding in the polynomial.

The characteristic polynomial is found modulo primes by reduction to Hessenberg
form (one prime after the other in Spark tasks) and put together by the Chinese
remainder theorem. All its roots are real and not negative, as the matrix is a
scatter; so the number of roots above a point, repeated ones included, is exactly
the number of sign changes among the coefficients of the polynomial moved to that
point (Budan and Fourier). Halving by that count isolates the largest roots with
their multiplicities. Inverse iteration in long decimals gives a basis of each
root's null space.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

WIDTH_BITS = 128  # roots are known to one part in 2**WIDTH_BITS
MIN_DIGITS = 120  # of the arithmetic of inverse iteration


class Component(NamedTuple):
    """An eigenvalue, as numerator / 2**bits, and its unit eigenvector."""

    numerator: int
    bits: int
    vector: np.ndarray


def primes_below(top: int) -> Iterator[int]:
    """Primes under `top` (at most 2**32), the largest first."""
    candidate = top - 1 if top % 2 == 0 else top - 2
    while candidate > 2:
        # Bases 2, 3, 5 and 7 decide below 3,215,031,751, and 11 beyond.
        if all(candidate % p for p in (3, 5, 7, 11, 13)) and all(_passes(candidate, base) for base in (2, 3, 5, 7, 11)):
            yield candidate
        candidate -= 2


def _passes(n: int, base: int) -> bool:
    """Miller's test of an odd number by one base."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, n)
    return x in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1))


def charpoly_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x I - matrix) modulo a prime below 2**31, from the constant one to x**d."""
    a = matrix.astype(np.int64) % p
    d = len(a)
    for j in range(d - 2):
        nonzero = np.flatnonzero(a[j + 1 :, j])
        if not len(nonzero):
            continue
        pivot = j + 1 + int(nonzero[0])
        if pivot != j + 1:
            a[[pivot, j + 1]] = a[[j + 1, pivot]]
            a[:, [pivot, j + 1]] = a[:, [j + 1, pivot]]
        factor = a[j + 2 :, j] * pow(int(a[j + 1, j]), -1, p) % p
        a[j + 2 :, j:] = (a[j + 2 :, j:] - factor[:, None] * a[j + 1, j:] % p) % p
        a[:, j + 1] = (a[:, j + 1] + (a[:, j + 2 :] * factor % p).sum(axis=1)) % p
    # Polynomials of the leading blocks, by expansion along the last column.
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        column = np.empty(k, np.int64)
        below = 1
        for i in range(k - 1, -1, -1):
            column[i] = a[i, k - 1] * below % p
            if i:
                below = below * int(a[i, i - 1]) % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (column[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix), from the constant one up, of a positive semidefinite integer matrix.

    The k-th elementary symmetric function of roots that are not negative is at
    most C(d, k) (trace / d)**k, which bounds the coefficients and so the number of
    primes. Each prime is a row of a table; a task sees the matrix modulo a prime only.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)) if d else 1
    primes, product = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        product *= p
        if product > 2 * bound:
            break
    whole = spark.sparkContext.broadcast([[str(x) for x in row] for row in matrix])

    def residues(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact = np.array([[int(x) for x in row] for row in whole.value], object).reshape(d, d)
        for frame in frames:
            listed = [charpoly_modulo((exact % int(p)).astype(np.int64), int(p)) for p in frame["p"]]
            yield pd.DataFrame({"p": frame["p"], "coefficients": [c.tolist() for c in listed]})

    tasks = min(len(primes), max(1, spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInPandas(residues, "p long, coefficients array<long>").collect()
    total = [0] * (d + 1)
    for p, coefficients in rows:
        rest = product // p
        unit = rest * pow(rest, -1, p)
        for k, c in enumerate(coefficients):
            total[k] += c * unit
    return [c - product if (c := t % product) > product // 2 else c for t in total]


def roots_above(polynomial: list[int], numerator: int, bits: int) -> int:
    """How many roots, with multiplicity, lie above numerator / 2**bits; all roots must be real."""
    c = [x << bits * (len(polynomial) - 1 - k) for k, x in enumerate(polynomial)]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += numerator * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value_sign(polynomial: list[int], numerator: int, bits: int) -> int:
    value = 0
    for k, x in enumerate(reversed(polynomial)):
        value = value * numerator + (x << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int) -> list[tuple[int, int, int]]:
    """The largest positive roots as (numerator, bits, multiplicity), in falling order, until `count` are found.

    numerator / 2**bits is within one part in 2**WIDTH_BITS of the root. Roots closer
    than that count as one of higher multiplicity.
    """
    high, bits = 1, 0
    while roots_above(polynomial, high, 0):
        high *= 2
    found, seen = [], 0
    while seen < count and roots_above(polynomial, 0, 0) > seen:
        # The next root lies in (low, high] / 2**bits: more than `seen` roots above low, `seen` above high.
        low, inside = 0, 0
        while inside != 1 and low >> WIDTH_BITS == 0:
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            above = roots_above(polynomial, middle, bits) - seen
            low, high, inside = (middle, high, above) if above > 0 else (low, middle, inside)
        if inside == 1:
            low, high, bits = _refined(polynomial, low, high, bits)
        found.append((high, bits, inside))
        seen += inside
        # Go on below low, on the coarsest grid that keeps the roots found apart.
        coarse = next((b for b in range(0, bits, 8) if roots_above(polynomial, low >> bits - b, b) == seen), bits)
        high, bits = low >> bits - coarse, coarse
    return found


def _refined(polynomial: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """Narrows an interval (low, high] that holds one simple root, by the sign of the polynomial."""
    side = _value_sign(polynomial, high, bits)
    while side and low >> WIDTH_BITS == 0:
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        sign = _value_sign(polynomial, middle, bits)
        low, high = (middle, high) if sign == -side else (low, middle)
        side = sign if sign == 0 else side
    return low, high, bits


def null_space(matrix: list[list[int]], numerator: int, bits: int, dimension: int) -> list[np.ndarray]:
    """Orthonormal vectors that span the null space of matrix - root I, by inverse iteration in long decimals."""
    d = len(matrix)
    digits = MIN_DIGITS + 2 * max(len(str(x)) for row in matrix for x in row)
    with localcontext() as context:
        context.prec = digits
        root = Decimal(numerator) / Decimal(2) ** bits
        a = np.array([[Decimal(x) for x in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= root
        size = max(abs(x) for x in a.ravel()) or Decimal(1)
        tiny = size * Decimal(10) ** -(digits - 20)
        order = np.arange(d)
        for k in range(d):
            best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                order[[k, best]] = order[[best, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - a[k + 1 :, k][:, None] * a[k, k + 1 :]
        vectors = [np.array([Decimal((i * 7919 + 104729 * (m + 1)) % 1009 + 1) for i in range(d)], object) for m in range(dimension)]
        for _ in range(3):
            for m in range(dimension):
                v = vectors[m][order]
                for i in range(1, d):
                    v[i] -= a[i, :i] @ v[:i]
                for i in range(d - 1, -1, -1):
                    v[i] = (v[i] - (a[i, i + 1 :] @ v[i + 1 :] if i + 1 < d else 0)) / a[i, i]
                # Twice, as the first subtraction loses digits.
                for _ in range(2):
                    v = v / max(abs(x) for x in v)
                    for other in vectors[:m]:
                        v = v - (v @ other) * other
                vectors[m] = v / (v @ v).sqrt()
        return [np.array([float(x) for x in v]) for v in vectors]


def leading_components(spark: SparkSession, matrix: list[list[int]], count: int) -> list[Component]:
    """Up to `count` components of a positive semidefinite integer matrix with a positive eigenvalue, by falling eigenvalue.

    Equal eigenvalues have an orthonormal basis of their space, the same in every run.
    """
    found: list[Component] = []
    if not matrix or not any(matrix[i][i] for i in range(len(matrix))):
        return found
    for numerator, bits, multiplicity in largest_roots(characteristic_polynomial(spark, matrix), count):
        wanted = min(multiplicity, count - len(found))
        found += [Component(numerator, bits, v) for v in null_space(matrix, numerator, bits, multiplicity)[:wanted]]
    return found
