"""Whitens vectors by the leading components of their exact integer scatter.

Entries become integers. The scatter n * sum(x x^T) - S S^T of the distinct integer
vectors is summed without rounding: each task multiplies limbs of LIMB_BITS bits in
doubles that stay below 2**53, and Spark adds the tasks' totals limb by limb. The
matrix of dimensions x dimensions alone reaches the driver; its eigenvalues and
eigenvectors come from the exact characteristic polynomial (see charpoly).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.charpoly import Component, leading_components
from loadweave.llm.columns import releasing
from loadweave.session import stage

SCALE = 256
LIMB_BITS = 20
BLOCK_ROWS = 4096  # of vectors that are multiplied at once: 2**12 products of 2**40 stay below 2**53


class Fit(NamedTuple):
    """n distinct vectors with sums `total`, and the components of n**2 times their covariance, whose trace is `trace`."""

    n: int
    total: list[int]
    components: list[Component]
    trace: int


def integer_codes(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """key and code of the rows whose vector has finite entries alone: floor(scale * c) of each entry, in order, as bytes.

    The code is the width of an integer in bytes (2, 4 or 8, the least that holds all
    entries) and the little-endian integers, so equal vectors have equal codes. Entries
    beyond 64 bits take the nearest 64-bit integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            finite = np.isfinite(value)
            row = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(row[~finite], minlength=len(sizes)) == 0
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(value * scale)
                # 2.0**63 is no 64-bit integer, the double before it is.
                whole = np.where(finite, np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)), 0.0).astype(np.int64)
            whole[finite & (scaled >= 2.0**63)] = np.iinfo(np.int64).max
            size = np.abs(whole.astype(np.float64))
            largest = np.zeros(len(sizes))
            np.maximum.at(largest, row, size)
            width = np.where(largest < 2**15, 2, np.where(largest < 2**31, 4, 8))
            parts = np.split(whole, np.cumsum(sizes)[:-1]) if len(sizes) else []
            codes = [bytes([w]) + part.astype(f"<i{w}").tobytes() if ok else None for ok, w, part in zip(good.tolist(), width.tolist(), parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(codes, pa.binary()).filter(pa.array(good))], names=["key", "code"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(releasing(run), T.StructType([T.StructField("key", vectors.schema[key].dataType), T.StructField("code", T.BinaryType())]))


def decode(codes: pa.Array, dimensions: int) -> np.ndarray:
    """Codes of vectors of one length to a matrix of 64-bit integers."""
    raw = codes.to_pylist()
    widths = np.array([r[0] for r in raw], np.int64)
    out = np.zeros((len(raw), dimensions), np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(raw[i][1:] for i in at.tolist()), f"<i{w}").reshape(len(at), dimensions)
    return out


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers as sum of limb[k] * 2**(LIMB_BITS * k): all limbs but the last lie in [0, 2**LIMB_BITS), the last keeps the sign."""
    found = []
    while x.size and (x.max() >= 1 << LIMB_BITS or x.min() < -(1 << LIMB_BITS)):
        found.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS
    return [*found, x.astype(np.float64)]


def moments(codes: DataFrame, dimensions: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of integer vectors, exactly; codes: column code."""
    width = dimensions + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Totals of products by the power of 2**LIMB_BITS that they stand for, in Python integers.
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                x = decode(batch.column(0).slice(first, BLOCK_ROWS), dimensions)
                # A constant 1 beside each vector gives its sums and the number of vectors.
                parts = limbs(np.column_stack([x, np.ones(len(x), np.int64)]))
                for i, left in enumerate(parts):
                    for j, right in enumerate(parts):
                        product = (left.T @ right).astype(np.int64).astype(object)
                        totals[i + j] = totals[i + j] + product if i + j in totals else product
        cells, powers, values = [], [], []
        upper = np.triu_indices(width)
        for power, total in totals.items():
            for cell, value in zip((upper[0] * width + upper[1]).tolist(), total[upper].tolist()):
                # A task's total can pass 64 bits; its 32-bit digits never do, however many tasks there are.
                sign, value, digit = (-1 if value < 0 else 1), abs(value), 0
                while value:
                    cells.append(cell)
                    powers.append(power * LIMB_BITS + digit)
                    values.append(sign * (value & 0xFFFFFFFF))
                    value, digit = value >> 32, digit + 32
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(powers, pa.int32()), pa.array(values, pa.int64())], names=["cell", "power", "value"])

    # As many rows as the matrix has cells, times the few powers.
    summed = codes.select("code").mapInArrow(releasing(run), "cell long, power int, value long").groupBy("cell", "power").agg(F.sum("value").alias("value")).collect()
    matrix = [[0] * width for _ in range(width)]
    for cell, power, value in summed:
        i, j = divmod(cell, width)
        matrix[i][j] += value << power
    for i in range(width):
        for j in range(i):
            matrix[i][j] = matrix[j][i]
    return matrix[-1][-1], matrix[-1][:-1], [row[:-1] for row in matrix[:-1]]


def fit(codes: DataFrame, dimensions: int, components: int) -> Fit:
    """codes: the distinct vectors of one length."""
    n, total, products = moments(codes, dimensions)
    scatter = [[n * products[i][j] - total[i] * total[j] for j in range(dimensions)] for i in range(dimensions)]
    return Fit(n, total, leading_components(codes.sparkSession, scatter, components), sum(scatter[i][i] for i in range(dimensions)))


def _projector(f: Fit) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and per component (across) the unit vector over the root of its eigenvalue."""
    mean = np.array([s / f.n for s in f.total])
    # numerator / 2**bits is n**2 times the eigenvalue; Python divides integers of any size correctly.
    vectors = [c.vector / (sqrt(c.numerator / (f.n * f.n << c.bits))) for c in f.components]
    return mean, np.array(vectors).reshape(len(vectors), len(mean)).T


def project(rows: DataFrame, f: Fit, dimensions: int) -> DataFrame:
    """key, code to key, deviation, whitened (array, one entry per component)."""
    mean, projector = _projector(f)
    total_limbs: list[list[int]] = []
    rest = list(f.total)
    while True:
        total_limbs.append([abs(s) & 0xFFFFF if s >= 0 else -(abs(s) & 0xFFFFF) for s in rest])
        rest = [s >> 20 if s >= 0 else -(-s >> 20) for s in rest]
        if not any(rest):
            break
    sums = np.array(total_limbs, np.int64).reshape(len(total_limbs), dimensions).T
    squares = sum(s * s for s in f.total)
    n = f.n

    def deviations(x: np.ndarray) -> list[int]:
        """sum((n x - S)**2) = n**2 x.x - 2 n x.S + S.S, exactly."""
        if x.size and max(abs(int(x.max())), abs(int(x.min()))) >= 1 << 20:
            x = x.astype(object)
        own, crossed = (x * x).sum(axis=1).tolist(), (x @ sums.astype(x.dtype)).tolist()
        return [n * n * int(a) - 2 * n * sum(int(c) << 20 * k for k, c in enumerate(b)) + squares for a, b in zip(own, crossed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                x = decode(part.column(1), dimensions)
                white = (x - mean) @ projector
                offsets = pa.array(np.arange(len(x) + 1) * projector.shape[1], pa.int32())
                far = [d if d < 1 << 63 else None for d in deviations(x)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(far, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["key", "deviation", "whitened"])

    schema = T.StructType([rows.schema["key"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.select("key", "code").mapInArrow(releasing(run), schema)


def _identity_error(white: DataFrame, found: int) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity; 0 without components."""
    if not found:
        return 0.0
    pairs = [(i, j) for i in range(found) for j in range(i, found)]
    entry: Row = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(entry, pairs))


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: up to `components` rows for every usable vector.

    Rows whose vector is null or holds a null or non-finite entry are left out; the
    others stay, repeated rows and null keys too. x = floor(256 * c) of each entry.
    The fit list is each distinct x once. whitened: (x - mean) on unit eigenvector
    number `component` of the list's covariance, over the root of its eigenvalue e.
    explained: e over the trace. deviation: sum of (n x - S)**2, null where it passes
    64 bits. identity_error: of the covariance of the whitened list, by a pass over it.

    Vectors of different lengths are fitted apart, each length with its own list;
    vectors of fewer entries than `components` have as many components as entries, so
    empty ones have no row. A component without variance (eigenvalue 0) has a null
    `whitened` and an `explained` of 0, or null where nothing varies at all. Other
    columns are left out, so none can clash. An empty table gives an empty one.
    """
    rows = stage(integer_codes(vectors, key, vector), "codes")
    width = F.conv(F.hex(F.substring("code", 1, 1)), 16, 10).cast("int")
    sized = rows.withColumn("dimensions", ((F.octet_length("code") - 1) / width).cast("int"))
    distinct = stage(sized.select("dimensions", "code").distinct(), "distinct")
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), *[T.StructField(n, t) for n, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    result = vectors.sparkSession.createDataFrame([], schema)
    # One turn per length of the vectors.
    for (dimensions,) in distinct.filter("dimensions > 0").select("dimensions").distinct().sort("dimensions").collect():
        own = distinct.filter(F.col("dimensions") == dimensions)
        f = fit(own, dimensions, components)
        error = _identity_error(project(own.withColumn("key", F.lit(0)), f, dimensions), len(f.components))
        shares = [c.numerator / (f.trace << c.bits) for c in f.components]
        shares += [0.0 if f.trace else None] * (min(components, dimensions) - len(shares))
        listed = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.get("whitened", F.lit(k)).alias("whitened"), F.lit(share).cast("double").alias("explained")) for k, share in enumerate(shares)])
        white = project(sized.filter(F.col("dimensions") == dimensions), f, dimensions).select("key", "deviation", F.explode(listed).alias("one"))
        result = result.union(white.select(F.col("key").alias(key), "one.component", F.lit(f.n).cast("long").alias("n"), "deviation", "one.whitened", "one.explained", F.lit(error).alias("identity_error")))
    return result
