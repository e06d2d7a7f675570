"""Links between near vectors by product quantisation over inverted lists, with an exact rerank.

Coarse centroids split the unit vectors into inverted lists. The residual to
the centroid is coded by one of 256 centroids in each subspace. A query looks
up the distances of its residual to all subspace centroids once per list, sums
them by the codes of the list's members (asymmetric distances), and computes
the exact cosine where the distance, less the member's known coding error, may
reach the threshold. So coding loses no link; only lists that are not probed can.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.llm.components import components
from loadweave.session import stage

BLOCK = 2048  # members and queries of a list that meet in one task


class Index(NamedTuple):
    """centroids: lists x dimensions; codebook: subspaces x codes x (dimensions / subspaces)."""

    centroids: np.ndarray
    codebook: np.ndarray


def k_means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of a sample; empty ones take points at random."""
    k = max(1, min(k, len(points)))
    centers = points[rng.choice(len(points), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        nearest = nearest_centers(points, centers, 1)[:, 0]
        counts = np.bincount(nearest, minlength=k)
        sums = np.column_stack([np.bincount(nearest, points[:, d], k) for d in range(points.shape[1])])
        empty = counts == 0
        centers = sums / np.maximum(counts, 1)[:, None]
        centers[empty] = points[rng.choice(len(points), int(empty.sum()))]
    return centers


def nearest_centers(points: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each point, the nearest first; ties by number."""
    n = min(n, len(centers))
    found = []
    for part in np.array_split(points, max(1, len(points) * len(centers) // (4 << 20) + 1)):
        far = (centers**2).sum(axis=1) - 2 * part @ centers.T
        found.append(np.argmin(far, axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n])
    return np.concatenate(found)


def fit(sample: np.ndarray, lists: int, subspaces: int, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    centroids = k_means(sample, lists, 8, rng)
    residual = sample - centroids[nearest_centers(sample, centroids, 1)[:, 0]]
    width = -(-sample.shape[1] // subspaces)
    residual = np.pad(residual, ((0, 0), (0, width * subspaces - sample.shape[1])))
    books = [k_means(residual[:, s * width : (s + 1) * width], 256, 6, rng) for s in range(subspaces)]
    return Index(centroids, np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def links(vectors: DataFrame, threshold: float, lists: int | None = None, probes: int = 16, subspaces: int = 16, sample: int = 20_000) -> DataFrame:
    """vectors (id long, vec array<double>, distinct and of one length, none zero) to linked pairs (a < b).

    lists: the square root of the number of vectors by default, at most a
    twentieth of the sample. The index is fitted on about `sample` vectors, chosen
    by the hash of their id and brought to the driver; every vector is indexed
    and every vector queries the lists of the `probes` nearest centroids.

    A list is cut into blocks of members and of queries that meet block by
    block, so a list that holds much of the table is many tasks.
    """
    n = vectors.count()
    if n < 2:
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    rows = vectors.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))).select("vec").limit(2 * sample).collect()
    rows = rows or vectors.select("vec").limit(2).collect()
    unit = np.array([r[0] for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit[np.lexsort(unit.T)]
    lists = lists or max(1, min(int(n**0.5), len(unit) // 20))
    index = fit(unit, lists, min(subspaces, unit.shape[1]))
    width = index.codebook.shape[2]
    spaces = len(index.codebook)
    full = width * spaces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = nearest_centers(x, index.centroids, probes)
            residual = np.pad(x - index.centroids[near[:, 0]], ((0, 0), (0, full - x.shape[1])))
            codes = np.column_stack([nearest_centers(residual[:, s * width : (s + 1) * width], index.codebook[s], 1)[:, 0] for s in range(spaces)]).astype(np.uint8)
            coded = np.concatenate([index.codebook[s][codes[:, s]] for s in range(spaces)], axis=1)
            error = np.linalg.norm(residual - coded, axis=1)
            flat = pa.array(near.ravel(), pa.int32())
            offsets = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(near[:, 0], pa.int32()), pa.ListArray.from_arrays(offsets, flat), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["id", "vec", "list", "probes", "code", "error"],
            )

    placed = stage(vectors.select("id", "vec").mapInArrow(place, "id long, vec array<double>, list int, probes array<int>, code binary, error double"), "placed")
    queries = placed.select("id", "vec", F.explode("probes").alias("list"))
    # One row per list: as many as there are centroids.
    sizes = placed.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("m"))
    sizes = sizes.join(queries.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("q")), "list")
    sizes = F.broadcast(stage(sizes, "lists"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    members = placed.join(sizes, "list").select("list", part("m").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), "id", "vec", "code", "error")
    asking = queries.join(sizes, "list").select(F.col("list").alias("list_"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("mb_"), part("q").alias("qb_"), F.col("id").alias("asked"), F.col("vec").alias("query"))
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        ids, x = left.column("id").to_numpy(), _matrix(left.column("vec").chunk(0))
        asked, y = right.column("asked").to_numpy(), _matrix(right.column("query").chunk(0))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), spaces)
        reach = radius + left.column("error").to_numpy()
        center = index.centroids[left.column("list")[0].as_py()]
        found = []
        for low in range(0, len(asked), 256):
            query = np.pad(y[low : low + 256] - center, ((0, 0), (0, full - y.shape[1])))
            far = np.zeros((len(query), len(ids)))
            for s in range(spaces):
                table = ((query[:, None, s * width : (s + 1) * width] - index.codebook[s][None]) ** 2).sum(axis=2)
                far += table[:, codes[:, s]]
            q, m = np.nonzero(far <= reach**2 + 1e-9)
            q += low
            cosine = np.einsum("ij,ij->i", y[q], x[m])
            keep = (cosine >= threshold) & (asked[q] != ids[m])
            found.append(np.column_stack([asked[q][keep], ids[m][keep]]))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return members.groupBy("list", "mb", "qb").cogroup(asking.groupBy("list_", "mb_", "qb_")).applyInArrow(meet, "a long, b long").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", probes: int = 16, sample: int = 20_000) -> DataFrame:
    """key, n_links, component_id, kept of every vector, by cosine in double precision.

    n_links: other vectors at the threshold or above; component_id: the
    smallest key that links reach, the vector's own included; kept: that is its
    own key. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and so do those of another length with each
    other. Equal vectors are one node of the search and counted by their number.
    Null keys are left out; rows that repeat a key with the same vector are one.
    Other columns are left out.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.size("vec") > 0, F.lit(False)) & F.forall(F.coalesce("vec", F.array().cast("array<double>")), number) & F.exists(F.coalesce("vec", F.array().cast("array<double>")), lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    rows = stage(rows.withColumn("usable", usable).distinct(), "vectors")
    # Scaled to a largest component of 1, so that squares neither overflow nor vanish; zeros lose their sign.
    top = F.array_max(F.transform("vec", F.abs))
    scaled = rows.filter("usable").select("id", F.transform("vec", lambda x: x / top + F.lit(0.0)).alias("vec"))
    nodes = stage(scaled.groupBy("vec").agg(F.min("id").alias("node"), F.countDistinct("id").alias("copies")), "nodes")
    found = None
    for length in sorted(r[0] for r in nodes.select(F.size("vec")).distinct().collect()):
        some = links(nodes.filter(F.size("vec") == length).select(F.col("node").alias("id"), "vec"), threshold, probes=probes, sample=sample)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "links")
    both = found.select("a", "b").union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    groups = components(found)
    node = nodes.join(linked, "node", "left").join(groups, "node", "left")
    node = node.select(F.col("vec").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    members = scaled.join(node, F.col("vec") == F.col("of")).select("id", "n_links", "component_id")
    alone = rows.filter("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return members.union(alone).select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
