"""The corpus pipeline: five stages that documents pass one after the other.

run(spark, sf_dir) applies them to the table `documents`; each stage reads what
the stage before it has written. All stages but the last return the columns of
`documents`. SQL cannot express the models and token ids, so ORACLE_SQL is None
and tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import dartminhash, langid, linededup, linequality, packing
from loadweave.llm.queries import Query, table
from loadweave.session import stage

#: Documents below this probability of being good are rejected. A bound well
#: under the 0.7 of a positive judgement: doubtful documents stay.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in a language; `und` goes (no text, or no letter in it)."""
    judged = langid.predict(docs, langid.learn(docs), language="_language", score="_score")
    return judged.filter(F.col("_language") != langid.UNKNOWN).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of good or doubtful quality, judged line by line."""
    model = linequality.learn(table(spark, sf_dir, "labels"), docs)
    return linequality.score(docs, model, out="_score").filter(F.col("_score") >= LEAST_QUALITY).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each class of near copies."""
    classes = dartminhash.near_duplicates(docs, 0.8)
    dropped = classes.filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti").select(docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that occurred before out of the texts; n_chars counts what is left."""
    clean = linededup.remove_repeated_lines(docs, removed="_removed")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1024 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    stored = stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(stored, 1024)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_lines", repeated_lines),
    ("sequences", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
