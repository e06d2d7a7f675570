"""A uniform shuffle of a table into shards in two passes over the data.

First pass: a seeded hash of every record scatters the records uniformly into
buckets that fit in memory. Second pass: every bucket is brought into a fixed
order, shuffled by Fisher-Yates with a seed of its own, and written. The
buckets one after the other are the shuffled table; shards are stretches of it
whose row counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.session import stage

LEAST_BUCKETS = 64
BUCKETS_PER_RUN = 8192  # at 16 MB a bucket, 128 GB of texts


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of n places, the same for the same seed."""
    order = np.arange(n)
    # Generator.shuffle swaps each place with one drawn from those before it.
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)
    return order


def shard_bounds(rows: int, shards: int) -> np.ndarray:
    """First row of each shard in the shuffled table, and the number of rows."""
    return np.array([i * rows // shards for i in range(shards + 1)], np.int64)


def external_shuffle(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 42, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (0, 1, ... in each shard) to all records.

    Buckets: as many as the UTF-8 bytes of the texts over bucket_bytes, 64 at
    least, so small tables use many tasks as well. The scatter has a partition
    for each bucket, whatever the session's number of shuffle partitions, so
    what a task reads does not grow with the table. Records equal in key and
    text are interchangeable and share a bucket. Null keys and null texts are
    records like others; an empty table gives none. Columns shard and slot are
    replaced; all others pass through. The result depends on the records, the
    seed and the parameters alone, not on partitions or lost executors.

    To the driver: two numbers, and one count per run of BUCKETS_PER_RUN buckets.
    """
    kept = docs.drop("shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    total, rows = kept.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    bucketed = kept.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), F.lit(buckets)).cast("int"))
    starts = bucket_starts(bucketed.groupBy("_bucket").count())
    bounds = shard_bounds(rows, shards)
    schema = T.StructType([*kept.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = kept.columns

    def shuffle(rows: pa.Table) -> pa.Table:
        bucket, first = (rows.column(name)[0].as_py() for name in ("_bucket", "_start"))
        rows = rows.select(names)
        rows = rows.take(pa.compute.sort_indices(rows.select([key, text]), sort_keys=[(key, "ascending"), (text, "ascending")]))
        rows = rows.take(pa.array(fisher_yates(len(rows), (seed, bucket))))
        place = first + np.arange(len(rows))
        shard = np.searchsorted(bounds, place, "right") - 1
        return rows.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(place - bounds[shard], pa.int64()))

    # A bucket is a partition on both sides, so the join and the groups need no shuffle of their own.
    scattered = bucketed.repartitionById(buckets, "_bucket").join(starts.repartitionById(buckets, "_bucket"), "_bucket")
    return scattered.groupBy("_bucket").applyInArrow(shuffle, schema)


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(_bucket, count) to (_bucket, _start): the rows in all buckets before, summed in runs of buckets."""
    counts = stage(counts.withColumn("_run", F.floor(F.col("_bucket") / BUCKETS_PER_RUN)), "buckets")
    before = [0]
    totals = {r[0]: r[1] for r in counts.groupBy("_run").agg(F.sum("count")).collect()}
    for run in range(max(totals, default=-1) + 1):
        before.append(before[-1] + totals.get(run, 0))
    base = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (F.col("_run") + 1).cast("int"))
    inside = F.sum("count").over(Window.partitionBy("_run").orderBy("_bucket")) - F.col("count")
    return counts.select("_bucket", (base + inside).alias("_start"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes a folder per shard. A bucket lies in one or two shards, so there are about as many files as buckets; rows carry their slot."""
    shuffled.write.mode("overwrite").partitionBy("shard").parquet(path)
