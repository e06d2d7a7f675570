"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import bpe, dartminhash, decontaminate, editsketch, hyperplanetree, langid, linededup, linequality, packing, pqindex, sharding, urltree, whitening
from loadweave.session import scratch_path, stage


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """The remainder of the checksum of a key's decimal text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, folder, "documents")
    held_out = fold("doc_id", 5) == 0
    model = langid.learn(docs.filter(~held_out))
    # Only the text reaches the prediction; the key passes through.
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens: one row per piece."""
    pieces = packing.token_pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    stored = stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(stored, 1024)


@query("op3_near_duplicates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near copies of every document: five words, similarity 0.8."""
    return dartminhash.near_duplicates(table(spark, folder, "documents"), 0.8)


@query("op4_near_vectors")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return pqindex.near_vectors(table(spark, folder, "embeddings"), 0.9)


@query("op5_edit_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return editsketch.compare_with_next(table(spark, folder, "documents").select("doc_id", "text"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again: counts and digests.

    Encoding, decoding and digests share one Python worker per task; ids and
    decoded bytes never leave it.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.merges(path)
        decimal = [str(i) for i in range(vocabulary.size)]
        for batch in batches:
            for i, j, values, counts in bpe.encode_column(batch.column(1), path):
                listed, decoded = [], []
                for ids in np.split(values, np.cumsum(counts)[:-1]):
                    listed.append(hashlib.sha256(",".join([decimal[x] for x in ids.tolist()]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return table(spark, folder, "documents").select("doc_id", "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op7_repeated_lines")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that occurred before, and where those were."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return linededup.remove_repeated_lines(docs).withColumn("n_removed", F.size("removed"))


def quality_model(spark: SparkSession, folder: str) -> linequality.Model:
    """Learned from three quarters of the labelled documents."""
    labels = table(spark, folder, "labels").filter(fold("doc_id", 4) != 2)
    return linequality.learn(labels, table(spark, folder, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of every document."""
    docs = table(spark, folder, "documents").select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    scored = linequality.score(docs, quality_model(spark, folder)).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


# The rules that the query is to apply.
URL_RULES = [
    urltree.Rule("allow", "com", "/"),
    urltree.Rule("block", "example.com", "/en/"),
    urltree.Rule("allow", "www.example.com", "/en/"),
    urltree.Rule("block", "net", "/es/"),
    urltree.Rule("block", "net", "/fr/"),
]


@query("op9_url_filter")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's url."""
    judged = urltree.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op10_shards")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, written to 16 shards in shuffled order and read back."""
    shuffled = sharding.external_shuffle(table(spark, folder, "documents").select("doc_id", "text"), 16)
    path = scratch_path(spark, "shards")
    sharding.write_shards(shuffled, path)
    shards = spark.read.schema(shuffled.schema).parquet(path)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return shards.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """All usable vectors on the four leading components of their exact covariance."""
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op12_decontamination",
    f"""
    WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
    items AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    sized AS (SELECT item_id, words, least(len(words), 10) AS size FROM items WHERE len(words) > 0),
    windows AS (SELECT DISTINCT item_id, size, words[k : k + size - 1] AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS k FROM sized)),
    grams AS (
      SELECT doc_id, size, k, words[k : k + size - 1] AS gram
      FROM (SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS k FROM docs, (SELECT DISTINCT size FROM windows))),
    hits AS (SELECT doc_id, item_id, k, w.size FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram),
    covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(listed.n, 0) AS BIGINT) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The words of every document that lie in windows of ten words of a benchmark item."""
    found = decontaminate.find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(
    "op13_hard_negatives",
    """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([c IS NOT NULL AND isfinite(c) FOR c IN embedding]), true)),
    scores AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
      FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
    positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
      id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hyperplanetree.hard_negatives(moved, lambda key: key % 100 == 0)
