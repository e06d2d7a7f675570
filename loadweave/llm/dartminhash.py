"""Near-duplicate documents by DartMinHash signatures, banded joining and an exact check.

Every weighted shingle spans a region of weight x rank. Into each unit cell of
the plane a Poisson number of darts falls, decided by the hash of the shingle
and the cell. A dart within the shingle's weight counts for one coordinate of
the signature; the dart of lowest rank is the coordinate's value. About
k (ln k + 4) darts are looked at per document, whatever its length, and the
ranks looked at are doubled for documents that leave a coordinate empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.llm.columns import U, mix, releasing, row_slices, text_bytes
from loadweave.llm.components import components
from loadweave.llm.shingles import elements, similarities
from loadweave.session import stage

SLICE_BYTES, SLICE_ROWS = 1 << 20, 200
#: Cumulative probabilities of 0, 1, ... darts in a cell of area one.
POISSON = np.exp(-1.0) * np.cumsum(1 / np.cumprod([1.0, *range(1, 12)]))
BANDS, ROWS = 32, 6
BLOCK = 1024  # nodes of a bucket
CHECK_ROWS = 400
MOST_CELLS = 1 << 18


def _throw(element: np.ndarray, row: np.ndarray, cells: np.ndarray, depth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The darts that hit: coordinate (over all rows), rank, and the dart itself."""
    rank = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix(np.repeat(element, cells) + rank.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    row = np.repeat(row, cells)
    number = np.searchsorted(POISSON, (cell >> U(11)) * 2.0**-53, "right")
    thrown = np.repeat(np.arange(len(cell)), number)
    which = np.arange(len(thrown)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(cell[thrown] + (which + 1).astype(np.uint64) * U(0x165667B19E3779F9))
    height = rank[thrown] + (dart >> U(11)) * 2.0**-53
    row = row[thrown]
    hit = height < depth[row]
    dart = dart[hit]
    return row[hit] * k + ((mix(dart) >> U(32)) * U(k) >> U(32)).astype(np.int64), height[hit], dart


def signatures(elements_: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """k coordinates for each row of distinct unit-weight elements; rows without elements get zeros."""
    n = len(offsets) - 1
    result = np.zeros((n, k), np.uint64)
    open_ = np.flatnonzero(np.diff(offsets) > 0)
    darts = k * (np.log(k) + 4)
    while len(open_):
        sizes = np.diff(offsets)[open_]
        depth = darts / sizes
        row = np.repeat(np.arange(len(open_)), sizes)
        element = elements_[np.repeat(offsets[open_] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(row))]
        cells = np.ceil(depth).astype(np.int64)[row]
        earliest = np.full(len(open_) * k, np.inf)
        values = np.zeros(len(open_) * k, np.uint64)
        for low, high in row_slices(np.concatenate([[0], np.cumsum(cells)]), MOST_CELLS):
            place, height, dart = _throw(element[low:high], row[low:high], cells[low:high], depth, k)
            np.minimum.at(earliest, place, height)
            winner = height == earliest[place]
            values[place[winner]] = dart[winner]
        values = values.reshape(-1, k)
        full = np.isfinite(earliest).reshape(-1, k).all(axis=1)
        result[open_[full]] = values[full]
        open_ = open_[~full]
        darts *= 2
    return result


def band_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, digest of the text, and one 64-bit key per band; no keys for a text without words."""
    schema = T.StructType([docs.schema[key], T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    tags = mix(np.arange(1, bands + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for i, j in row_slices(offsets, SLICE_BYTES, SLICE_ROWS):
                values, at = elements(batch.column(2).slice(i, j - i))
                coordinates = signatures(values, at, bands * rows).reshape(-1, bands, rows)
                folded = np.broadcast_to(tags, coordinates.shape[:2])
                for r in range(rows):
                    folded = mix(folded + coordinates[:, :, r])
                some = np.diff(at) > 0
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(folded[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), keys], names=[key, "digest", "keys"])

    return docs.select(key, F.unhex(F.md5(text)).alias("digest"), text).mapInArrow(releasing(run), schema)


def alike(df: DataFrame) -> DataFrame:
    """For joins with texts: the same plan at every size, as both sides grow with the documents."""
    return df.hint("merge")


def similar_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids in texts (id, text) whose weighted similarity reaches the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for i, j in row_slices(offsets, SLICE_BYTES, CHECK_ROWS):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(similarities(part.column(2), part.column(3)) >= threshold)).select(["a", "b"])

    joined = alike(pairs.join(alike(left), "a")).join(alike(right), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(releasing(run), T.StructType([pairs.schema["a"], pairs.schema["b"]]))


def element_sets(texts: DataFrame) -> DataFrame:
    """id and the elements of the text as sorted unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in row_slices(offsets, SLICE_BYTES):
                values, at = elements(batch.column(1).slice(i, j - i))
                sets = [np.sort(values[a:z]).tobytes() for a, z in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["id", "elements"])

    return texts.select("id", "text").mapInArrow(releasing(run), T.StructType([texts.schema["id"], T.StructField("elements", T.BinaryType())]))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left (down) has in common with each on the right (across)."""
    sizes = [list(map(len, side)) for side in (left, right)]
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = sum(sizes[0])
    on_both = np.intersect1d(place[:cut], place[cut:])
    column = np.full(len(values), -1)
    column[on_both] = np.arange(len(on_both))
    columns = column[place]
    rows = [np.repeat(np.arange(len(side)), size) for side, size in zip((left, right), sizes)]
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(on_both), 4096):
        marks = []
        for side, at in zip(rows, (columns[:cut], columns[cut:])):
            inside = (at >= low) & (at < low + 4096)
            mark = np.zeros((side[-1] + 1 if len(side) else 0, min(4096, len(on_both) - low)), np.float32)
            mark[side[inside], at[inside] - low] = 1
            marks.append(mark)
        total[: len(marks[0]), : len(marks[1])] += marks[0] @ marks[1].T
    return total


def links_across(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes of one bucket in different components: nodes (bucket, id, component, n) to pairs (a, b).

    A bucket is cut into blocks of about BLOCK nodes that meet pair by pair;
    the similarities of two blocks are one matrix product over their elements.
    Of the links between two components, one per pair of blocks is returned.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    sets = element_sets(texts.join(alike(nodes.select("id").distinct()), "id"))
    blocked = nodes.withColumns({"part": F.pmod(F.xxhash64("id"), parts).cast("int"), "with": F.explode(F.sequence(F.lit(0), parts - 1))})
    blocked = blocked.select("bucket", "id", "component", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    schema = T.StructType([T.StructField("a", nodes.schema["id"].dataType), T.StructField("b", nodes.schema["id"].dataType)])

    def meet(rows: pa.Table) -> pa.Table:
        ids, groups = rows.column("id").to_numpy(), rows.column("component").to_numpy()
        part, i, j = rows.column("part").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()]
        x, y = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found = np.zeros((0, 2), ids.dtype)
        if len(x) and len(y) and (groups != groups[0]).any():
            sizes = np.array([len(s) for s in sets])
            shared = shared_counts([sets[k] for k in x], [sets[k] for k in y])
            alike = shared >= threshold * (sizes[x][:, None] + sizes[y][None] - shared) - 1e-6
            p, q = np.nonzero(alike & (groups[x][:, None] != groups[y][None]))
            p, q = x[p], y[q]
            _, one = np.unique(np.sort(np.column_stack([groups[p], groups[q]]), axis=1), axis=0, return_index=True)
            found = np.column_stack([ids[p[one]], ids[q[one]]])
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return blocked.join(alike(sets), "id").groupBy("bucket", "i", "j").applyInArrow(meet, schema).distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, copy_of, class_id, kept: the class of near copies of every document.

    Documents with the same text (copy_of: the smallest key among them) are one
    node. Two nodes are linked if they share a band of their signatures and the
    weighted Jaccard similarity of their five-word shingles, taken from the
    whole texts, reaches the threshold. Classes are the connected components;
    class_id is the smallest key in the class, kept marks that document.

    Each bucket of a band first compares all its nodes with its smallest one.
    Where that leaves nodes of one bucket in different classes, all pairs of
    the bucket that lie in different classes are compared as well, block by
    block and without listing them, so no link between different classes is
    lost. A class costs one comparison per node and band; only texts that share
    a band but no class cost the square of their number.

    A null text, or one without words, is near nothing; equal empty texts are
    copies of each other, null texts are not. Null keys are left out; rows
    that repeat a key count once. Other columns are left out.
    """
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    keyed = stage(band_keys(docs, "id", "text", bands, rows), "signatures")
    # Stored, so that the join shuffles both sides anew and Spark can split a very common text.
    classes = stage(keyed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("copy_of")), "classes")
    members = keyed.select("id", "digest").join(classes, "digest", "left").groupBy("id").agg(F.min(F.coalesce("copy_of", "id")).alias("copy_of"))
    members = stage(members, "copies")

    nodes = keyed.filter(F.size("keys") > 0).join(members.filter("id = copy_of").select("id"), "id").select("id", F.explode("keys").alias("bucket")).distinct()
    buckets = stage(nodes.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    entries = stage(nodes.join(buckets, "bucket"), "entries")
    stars = stage(entries.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

    texts = stage(_texts(docs, stars), "texts")
    links = stage(similar_pairs(stars, texts, threshold), "links")
    groups = components(links)

    # Buckets whose nodes are not all in one class: their other pairs across classes.
    placed = entries.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("n").alias("n")).filter("low <> high AND n > 2").select("bucket")
    open_ = stage(placed.filter("id <> first").join(mixed, "bucket").select("bucket", "id", "component", "n"), "open")
    if not open_.isEmpty():
        links = links.union(links_across(open_, texts, threshold))
        groups = components(links)

    found = members.join(groups.withColumnRenamed("node", "copy_of"), "copy_of", "left").withColumn("class_id", F.coalesce("component", "copy_of"))
    return found.select(F.col("id").alias(key), "copy_of", "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the documents that pairs name."""
    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return docs.join(alike(named), "id").dropDuplicates(["id"])
