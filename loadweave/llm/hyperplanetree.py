"""Hard negatives by exact window search in a multiway hyperplane tree.

Vectors are integers. A vector y is lifted by one coordinate, sqrt(R**2 - |y|**2)
with R the largest length, and a query a by a zero, so that the distance of a and y
falls as their inner product s rises: d**2 = |a|**2 + R**2 - 2 s. A window of inner
products is an annulus of distances.

A node of the tree has up to FANOUT split points from a sample; a vector belongs to
the nearest. Every split point stores the least and the largest distance to each
subtree of its node, over all vectors. A subtree is passed over if, for one split
point, that range and the query's annulus around its distance to the split point do
not meet. Leaves that stay are compared exactly, in integers.

The first search of a query visits the likeliest leaves until they hold enough
vectors; what it finds narrows the window of the second, which visits every
leaf that is left. Leaves are cut into blocks of vectors and of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.columns import releasing
from loadweave.session import stage

SCALE = 256
LARGEST = float(1 << 26)  # entries below it give inner products of up to 2,048 dimensions within 64 bits
ENDLESS = 1 << 62  # the end of an open window of inner products
FANOUT = 12
BLOCK = 4096  # vectors and queries of a leaf that meet in one task
AT_ONCE = 256  # queries whose scores are in memory
LEAF = 1024  # vectors of a leaf, at least
SEED = 256  # times the wanted number of vectors: how many the first search looks at
SAMPLE = 1 << 18


class Node(NamedTuple):
    """points: lifted split points; children: number of the inner node or, as -1 - number, of the leaf of each."""

    points: np.ndarray
    children: list[int]


class Tree(NamedTuple):
    """nodes: inner nodes, the root first; leaves: their number; low, high: per node, split points x subtrees."""

    nodes: list[Node]
    leaves: int
    radius: float
    low: list[np.ndarray]
    high: list[np.ndarray]


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, radius**2 - (x**2).sum(axis=1)))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * x @ points.T
    return np.sqrt(np.maximum(square, 0.0))


def slack(length: float, dimensions: int) -> float:
    """More than distances of vectors up to a length can be wrong: the root of the rounding of a square."""
    return 16 * length * float(np.sqrt((dimensions + 8) * np.finfo(np.float64).eps)) + 1e-9


def grow(sample: np.ndarray, radius: float, leaf: int, fanout: int = FANOUT, seed: int = 13) -> Tree:
    """Splits the distinct vectors of a sample until about `leaf` of them share a leaf.

    Split points are drawn far from each other, by chance in proportion to the
    squared distance to the nearest one drawn.
    """
    rng = np.random.default_rng(seed)
    points = lifted(sample, radius)
    apart = slack(radius, sample.shape[1])
    nodes: list[Node] = []
    leaves = 0
    work = [(np.arange(len(points)), -1, -1)]
    while work:
        own, parent, place = work.pop()
        number = None
        if len(own) > leaf or parent < 0:
            chosen = [int(rng.integers(len(own)))]
            nearest = distances(points[own], points[own[chosen]])[:, 0]
            while len(chosen) < min(fanout, max(2, len(own) // leaf)) and nearest.max() > apart:
                chosen.append(int(rng.choice(len(own), p=nearest**2 / (nearest**2).sum())))
                nearest = np.minimum(nearest, distances(points[own], points[own[chosen[-1:]]])[:, 0])
            if len(chosen) > 1 or parent < 0:
                number = len(nodes)
                nodes.append(Node(points[own[chosen]], [0] * len(chosen)))
                side = distances(points[own], nodes[number].points).argmin(axis=1)
                work += [(own[side == k], number, k) for k in range(len(chosen))]
        if number is None:
            number, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            nodes[parent].children[place] = number
    return Tree(nodes, leaves, radius, [], [])


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    y = lifted(x, tree.radius)
    leaf = np.zeros(len(y), np.int32)
    work = [(0, np.arange(len(y)))]
    while work:
        number, own = work.pop()
        if not len(own):
            continue
        side = distances(y[own], tree.nodes[number].points).argmin(axis=1)
        for k, child in enumerate(tree.nodes[number].children):
            if child < 0:
                leaf[own[side == k]] = -1 - child
            else:
                work.append((child, own[side == k]))
    return leaf


def leaf_paths(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf (down) and level (across) the node on its path and the side taken there; -1 below the leaf."""
    paths: dict[int, list[tuple[int, int]]] = {}
    work: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
    while work:
        number, path = work.pop()
        for k, child in enumerate(tree.nodes[number].children):
            if child < 0:
                paths[-1 - child] = [*path, (number, k)]
            else:
                work.append((child, [*path, (number, k)]))
    deepest = max(map(len, paths.values()))
    table = np.full((tree.leaves, deepest, 2), -1, np.int64)
    for leaf, path in paths.items():
        table[leaf, : len(path)] = path
    return table[:, :, 0], table[:, :, 1]


def annulus(tree: Tree, query: np.ndarray, low: int, high: int) -> tuple[float, float]:
    """Distances of vectors whose inner product with the query is from `low` to `high`, a little widened."""
    own = float((query.astype(np.float64) ** 2).sum())
    base = own + tree.radius**2
    margin = slack(own**0.5 + tree.radius, len(query))
    near = max(0.0, base - 2.0 * high) ** 0.5 if high < ENDLESS else 0.0
    far = max(0.0, base - 2.0 * low) ** 0.5 if low > -ENDLESS else np.inf
    return near - margin, far + margin


def surviving(tree: Tree, query: np.ndarray, near: float, far: float) -> list[tuple[float, int]]:
    """Leaves that can hold a vector at a distance from near to far, those likely to hold one close to `near` first."""
    y = np.append(query.astype(np.float64), 0.0)
    found = []
    work = [0]
    while work:
        number = work.pop()
        node, low, high = tree.nodes[number], tree.low[number], tree.high[number]
        d = distances(y[None], node.points)[0]
        # From every split point: no vector of the subtree is nearer than `least` or farther than `most`.
        least = np.maximum(np.maximum(d[:, None] - high, low - d[:, None]), 0.0).max(axis=0)
        most = (d[:, None] + high).min(axis=0)
        for k in np.flatnonzero((low[0] <= high[0]) & (least <= far) & (most >= near)).tolist():
            child = node.children[k]
            if child < 0:
                found.append((abs(max(float(least[k]), float(d[k])) - near), -1 - child))
            else:
                work.append(child)
    return sorted(found)


def codes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, dimensions, x (little-endian 32-bit integers) of the rows that take part."""
    values = F.col(vector).cast("array<double>")
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), values.alias("v"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(F.forall("v", number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            whole = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i4")
            parts = [p.tobytes() for p in np.split(whole, np.cumsum(sizes)[:-1])] if len(sizes) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())], names=["id", "label", "dimensions", "x"])

    return rows.mapInArrow(releasing(run), "id long, label long, dimensions int, x binary")


def matrix(column: pa.Array | pa.ChunkedArray, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dimensions)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, a's down and b's across."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if top < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows of every group with their rank; Spark cuts each task's rows to n a group before it shuffles them."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


FOUND = pa.schema([("query", pa.int64()), ("window", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("twin", pa.bool_())])
QUERY = ["query", "window", "label", "x", "low", "high"]
QUERY_SCHEMA = "query long, window long, label long, x binary, low long, high long"


class Search:
    """A tree over all nodes (node, label, x, ids) of one length, stored by leaf."""

    def __init__(self, nodes: DataFrame, dimensions: int, leaf_rows: int | None = None):
        self.dimensions = dimensions
        n, square = nodes.count(), nodes.select("x").mapInArrow(_largest_square(dimensions), "square double").agg(F.max("square")).first()[0]
        # Leaves grow with the root of the number of vectors, and so does the sample that splits them.
        leaf_rows = leaf_rows or max(LEAF, int(n**0.5))
        wanted = min(SAMPLE, max(2048, 32 * n // leaf_rows))
        share = min(1.0, 1.1 * wanted / n)
        chosen = nodes.filter(F.pmod(F.xxhash64("node", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30))).select("x").limit(2 * wanted)
        sample = chosen.toArrow()["x"]
        sample = sample if len(sample) else nodes.select("x").limit(1).toArrow()["x"]
        points = np.unique(matrix(sample, dimensions), axis=0)
        tree = grow(points, float(np.sqrt(square)), max(4, int(leaf_rows * min(1.0, len(points) / n))))
        at = nodes.columns.index("x")
        self.placed = stage(nodes.mapInArrow(_placing(tree, dimensions, at), T.StructType([*nodes.schema.fields, T.StructField("leaf", T.IntegerType())])), "placed")
        # As many rows as the tree has split points, times the fan-out; then one row per leaf.
        ranges = self.placed.select("x", "leaf").mapInArrow(_ranges(tree, dimensions), "node int, point int, side int, low double, high double")
        low = [np.full((len(v.points), len(v.points)), np.inf) for v in tree.nodes]
        high = [np.full((len(v.points), len(v.points)), -np.inf) for v in tree.nodes]
        for r in ranges.groupBy("node", "point", "side").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
            low[r.node][r.point, r.side], high[r.node][r.point, r.side] = r.low, r.high
        self.tree = tree._replace(low=low, high=high)
        self.held = np.zeros(tree.leaves, np.int64)
        for r in self.placed.groupBy("leaf").count().toLocalIterator():
            self.held[r.leaf] = r["count"]

    def visits(self, queries: DataFrame, enough: int | None) -> DataFrame:
        """queries (query, window, label, x, low, high) with the leaves to visit.

        enough: stop at leaves with so many vectors, the likeliest first; None visits
        every leaf that can hold a vector of the window.
        """
        tree, dimensions, held = self.tree, self.dimensions, self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, leaves = [], []
                low, high = (batch.column(i).to_pylist() for i in (4, 5))
                for r, query in enumerate(matrix(batch.column(3), dimensions)):
                    found = [leaf for _, leaf in surviving(tree, query, *annulus(tree, query, low[r], high[r]))]
                    if enough is not None:
                        found = found[: int(np.searchsorted(np.cumsum(held[found]), enough)) + 1]
                    row += [r] * len(found)
                    leaves += found
                    if len(row) > 20_000 or r == batch.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row, pa.int64())).columns, pa.array(leaves, pa.int32())], names=[*batch.schema.names, "leaf"])
                        row, leaves = [], []

        return queries.select(*QUERY).repartition(_tasks(queries, queries.count() // 100), "query", "window").mapInArrow(releasing(run), f"{QUERY_SCHEMA}, leaf int")

    def meet(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """query, window, id, score, twin: from every block that a query visits at least the first k of its window, by score, then id.

        twin: the vector is that of the query. The first k keys belong to the first k
        members by score, then smallest key, as each of those has a key at least as good.
        """
        dimensions = self.dimensions
        asked = stage(visits, "visits")
        cell = ["leaf", "label"] if same else ["leaf"]
        blocks = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        sizes = stage(blocks(self.placed, "m").join(blocks(asked, "q"), cell), "blocks")
        part = lambda n, *keys: F.pmod(F.xxhash64(*keys, F.lit(31)), F.col(n)).cast("int")
        groups = [*cell, "mb", "qb"]
        # A group is much work on few bytes: tasks go by the number of groups, not by bytes.
        tasks = _tasks(asked, sizes.agg(F.sum(F.col("m") * F.col("q"))).first()[0] or 0)
        members = self.placed.join(sizes, cell).select(*cell, part("m", "node").alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), F.col("label").alias("own"), F.col("x").alias("y"), "ids")
        queries = asked.join(sizes, cell).select(*cell, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("mb"), part("q", "query", "window").alias("qb"), "query", "window", F.col("label").alias("mine"), "x", "low", "high")
        members, queries = members.repartition(tasks, *groups), queries.repartition(tasks, *groups)

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                left = left.take(np.argsort(pc.list_element(left["ids"], 0).to_numpy(), kind="stable"))
                y, labels, raw = matrix(left["y"], dimensions), left["own"].to_numpy(), np.array(left["y"].to_pylist(), object)
                ids = left["ids"].combine_chunks()
                listed, starts = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
                for at in range(0, right.num_rows, AT_ONCE):
                    some = right.slice(at, AT_ONCE)
                    mine, low, high = (some[c].to_numpy()[:, None] for c in ("mine", "low", "high"))
                    scores = products(matrix(some["x"], dimensions), y)
                    q, m = first_members(scores, ((labels == mine) == same) & (scores >= low) & (scores <= high), k)
                    copies = np.diff(starts)[m]
                    place = np.arange(copies.sum()) + np.repeat(starts[:-1][m] - (np.cumsum(copies) - copies), copies)
                    twin = raw[m] == np.array(some["x"].to_pylist(), object)[q]
                    q, score = np.repeat(q, copies), np.repeat(scores[q, m], copies)
                    found.append(pa.table([some["query"].take(pa.array(q)), some["window"].take(pa.array(q)), pa.array(listed[place]), pa.array(score), pa.array(np.repeat(twin, copies).astype(bool))], names=FOUND.names))
            return pa.concat_tables(found) if found else FOUND.empty_table()

        return members.groupBy(*groups).cogroup(queries.groupBy(*groups)).applyInArrow(search, "query long, window long, id long, score long, twin boolean")

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """query, window, id, score, twin, rank: the first k vectors of each window, among those of the same label or of the others."""
        order = [F.desc("score"), F.asc("id")]
        seeds = first_per_group(self.meet(self.visits(queries, SEED * k), same, k), ["query", "window"], order, k, "rank")
        reached = seeds.filter(F.col("rank") == k).select("query", "window", F.col("score").alias("reached"))
        narrowed = queries.join(reached, ["query", "window"], "left").withColumn("low", F.greatest("low", "reached")).drop("reached")
        return first_per_group(self.meet(self.visits(narrowed, None), same, k), ["query", "window"], order, k, "rank")


def _tasks(df: DataFrame, pieces: int) -> int:
    """Partitions for so many pieces of work: one each, as long as they are not many times the cores or Spark's own number."""
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, pieces // 64)
    return max(1, min(pieces, most))


def first_members(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores that fit of each row; of equal scores the first columns."""
    n = scores.shape[1]
    wide = int(np.abs(scores).max(initial=0)) >= (1 << 61) // max(n, 1)
    whole = np.unique(scores, return_inverse=True)[1].reshape(scores.shape) if wide else scores
    order = np.where(fits, whole * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
    best = np.argpartition(order, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), scores.shape)
    row = np.repeat(np.arange(len(scores)), best.shape[1])
    keep = fits[row, best.ravel()]
    return row[keep], best.ravel()[keep]


def _largest_square(dimensions: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = (matrix(batch.column(0), dimensions).astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([top])], names=["square"])

    return run


def _placing(tree: Tree, dimensions: int, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = descend(tree, matrix(batch.column(at), dimensions))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=[*batch.schema.names, "leaf"])

    return releasing(run)


def _ranges(tree: Tree, dimensions: int) -> Callable:
    """Distances from the split points of a node to the vectors of each side, by the leaf that they are stored under."""
    path_nodes, path_sides = leaf_paths(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int, int], float] = {}
        high: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            y = lifted(matrix(batch.column(0), dimensions), tree.radius)
            leaf = batch.column(1).to_numpy()
            for nodes, sides in zip(path_nodes[leaf].T, path_sides[leaf].T):
                for number in np.unique(nodes[nodes >= 0]).tolist():
                    own = np.flatnonzero(nodes == number)
                    far, side = distances(y[own], tree.nodes[number].points), sides[own]
                    for k in np.unique(side).tolist():
                        part = far[side == k]
                        for point, (a, z) in enumerate(zip(part.min(axis=0).tolist(), part.max(axis=0).tolist())):
                            cell = (number, point, k)
                            low[cell], high[cell] = min(a, low.get(cell, a)), max(z, high.get(cell, z))
        cells = list(zip(*low)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cells], pa.array(list(low.values()), pa.float64()), pa.array(list(high.values()), pa.float64())], names=["node", "point", "side", "low", "high"])

    return releasing(run)


def hard_negatives(
    vectors: DataFrame,
    anchors: Callable[[Column], Column],
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    shares: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which keys are anchors. A score is the inner product of the integers
    floor(256 * c) of two rows. An anchor's positives are its first `positives` other
    rows of its label; for each, the first `negatives` rows of other labels whose score
    is between shares[0] and shares[1] hundredths of the positive's; higher scores
    first, ties by smaller key. Fewer where there are no more.

    Rows with a null key, label or vector, with a null or non-finite component, or with
    one of 2**18 or more (products could pass 64 bits) take no part. Vectors of
    different lengths never meet; empty ones have a score of 0 with each other. Rows
    equal in key, label and integers are one row; rows that differ in one of these are
    others, also if they share the anchor's key. Of equal vectors of one label only as
    many keys are compared as a result can hold, the smallest ones. Other columns are
    left out, so none can clash. An empty table gives an empty one.
    """
    rows = stage(codes(vectors, key, vector, label).distinct(), "rows")
    # Copies within a label are one node with its smallest keys: the anchor itself may be one of them.
    keep = max(positives + 1, negatives)
    copies = first_per_group(rows, ["label", "dimensions", "x"], [F.asc("id")], keep, "copy")
    nodes = copies.groupBy("label", "dimensions", "x").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    nodes = stage(nodes.withColumn("node", F.xxhash64("label", "x", F.lit(3))), "nodes")
    asking = rows.filter(anchors(F.col("id")))
    out = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # One turn per length of the vectors.
    for (dimensions,) in nodes.select("dimensions").distinct().sort("dimensions").collect():
        search = Search(nodes.filter(F.col("dimensions") == dimensions).drop("dimensions"), dimensions)
        own = asking.filter(F.col("dimensions") == dimensions).drop("dimensions")
        # Anchors with equal vectors and labels ask once.
        queries = stage(own.select("label", "x").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
        anchor = stage(own.join(queries, ["label", "x"]).select(F.col("id").alias("anchor_id"), "query"), "anchors")
        endless = queries.withColumns({"window": F.lit(0).cast("long"), "low": F.lit(-ENDLESS).cast("long"), "high": F.lit(ENDLESS).cast("long")})
        near = stage(search.best(endless, True, positives + 1).select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "twin"), "positives")
        others = anchor.join(near, "query").filter((F.col("anchor_id") != F.col("positive_id")) | ~F.col("twin"))
        pairs = first_per_group(others, ["anchor_id", "query"], [F.desc("positive_score"), F.asc("positive_id")], positives, "place")
        pairs = stage(pairs.select("anchor_id", "query", "positive_id", "positive_score"), "pairs")
        # low * p <= 100 n <= high * p for whole n; windows of one query and positive score are one.
        hundred = F.col("positive_score").cast("decimal(25,0)")
        low, high = (F.ceil(hundred * shares[0] / 100), F.floor(hundred * shares[1] / 100))
        windows = pairs.select("query", F.col("positive_score").alias("window"), low.cast("long").alias("low"), high.cast("long").alias("high")).distinct()
        found = search.best(windows.filter("low <= high").join(queries, "query"), False, negatives)
        joined = pairs.join(found.select("query", F.col("window").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["query", "positive_score"])
        out = out.union(joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    return out
