"""Load history kept up to date from arriving payloads, and live scoring.

The history is one Parquet table partitioned by day. A batch rewrites only the days
it touches, by dynamic partition overwrite, from a merge that is stored first. Rows
carry the batch that wrote them, and the time up to which rows had left the history
by then. A batch that is run again after a crash starts from its stored merge, so a
day that the crash caught half replaced is written again in full. Days that have left
the history are not read; removing them is up to the store's retention rules.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadweave.functions.timeutil import naive, utc_from_iso
from loadweave.operators.align import combine_first
from loadweave.operators.dedup import keep_last
from loadweave.operators.features import live_features
from loadweave.plans.model import score
from loadweave.session import stage
from loadweave.sources.payloads import LOAD_PAYLOAD, flatten_load

KEEP_DAYS = 10
HISTORY_SCHEMA = "datetime timestamp_ntz, load_mw double, batch_id bigint, cutoff timestamp_ntz, day date"
MARK_SCHEMA = "batch_id bigint, content string"


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet, empty then."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    """All stored rows with batch_id, cutoff and day, those that have left the history too."""
    return _stored(spark, f"{root}/rows", HISTORY_SCHEMA)


def last_batch(spark: SparkSession, root: str) -> tuple[int | None, datetime | None]:
    """The newest batch in the history and the time up to which rows have left it."""
    return tuple(read_rows(spark, root).agg(F.max("batch_id"), F.max_by("cutoff", "batch_id")).first())


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The current history."""
    _, cutoff = last_batch(spark, root)
    rows = read_rows(spark, root)
    if cutoff is not None:
        # The day prunes partitions, the time cuts the first one.
        rows = rows.where((F.col("day") >= F.lit(cutoff.date())) & (F.col("datetime") > naive(cutoff)))
    return rows.select("datetime", "load_mw")


def new_values(payloads: DataFrame) -> DataFrame:
    """Values of a batch by time; of repeated times the latest update counts."""
    flat = flatten_load(payloads, only_type=None)
    timed = flat.select(
        utc_from_iso("start_date").alias("datetime"), utc_from_iso("updated_date").alias("_updated"), F.col("consumption_mw").alias("load_mw")
    ).where(F.col("datetime").isNotNull())
    return keep_last(timed, ["datetime"], ["_updated", "load_mw"]).select("datetime", "load_mw")


def merge_batch(payloads: DataFrame, root: str, batch_id: int, as_of: str, keep_days: int = KEEP_DAYS) -> None:
    """Merges one batch into the history; an empty batch changes nothing.

    Rows up to ``as_of`` minus ``keep_days`` leave the history, except that the
    very first batch is stored whole.
    """
    spark = payloads.sparkSession
    fresh = stage(new_values(payloads).withColumn("day", F.col("datetime").cast("date")), "batch")
    days = [r["day"] for r in fresh.select("day").distinct().collect()]
    if not days:
        return
    # Two places take turns; the mark, written last, names the batch whose merge is complete, and its content.
    place = f"{root}/merged/{batch_id % 2}"
    content = fresh.agg(F.sum(F.xxhash64("datetime", "load_mw").cast("decimal(20,0)"))).first()[0]
    mark = spark.createDataFrame([(batch_id, str(content))], MARK_SCHEMA)
    if _stored(spark, f"{place}/mark", MARK_SCHEMA).intersect(mark).isEmpty():
        newest, _ = last_batch(spark, root)
        cutoff = None if newest is None else datetime.fromisoformat(as_of) - timedelta(days=keep_days)
        base = read_rows(spark, root).where(F.col("day").isin(days)).select("datetime", "load_mw")
        merged = combine_first(fresh.drop("day"), base, "datetime", ["load_mw"])
        marked = merged.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "cutoff": F.lit(cutoff).cast("timestamp_ntz"), "day": F.col("datetime").cast("date")})
        marked.write.mode("overwrite").parquet(f"{place}/rows")
        mark.write.mode("overwrite").parquet(f"{place}/mark")
    dated = spark.read.schema(HISTORY_SCHEMA).parquet(f"{place}/rows").repartitionByRange("day", "datetime")
    dated.sortWithinPartitions("day", "datetime").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/rows")


def follow_history(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    clock: Callable[[], str] = utc_now,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Starts a stream that merges every payload file in ``landing`` and stops when none is left."""
    reader = spark.readStream.schema(LOAD_PAYLOAD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, root, batch_id, clock())

    return (
        reader.json(landing)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def live_prediction(
    spark: SparkSession, root: str, weather: DataFrame, model: PipelineModel, now: str, steps_per_hour: int = 2
) -> DataFrame:
    """One scored row for ``now`` from the stored history and the given weather."""
    return score(model, live_features(read_current(spark, root), weather, now, steps_per_hour=steps_per_hour))


def follow_predictions(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    weather: Callable[[], DataFrame],
    model: PipelineModel,
    out: str,
    clock: Callable[[], str] = utc_now,
    files_per_batch: int | None = None,
    steps_per_hour: int = 2,
) -> StreamingQuery:
    """History upsert followed by one scored row per batch below ``out``.

    If a batch cannot be merged, its row is computed from the stored history;
    then the stream stops with the error, so that a restart merges the batch
    and replaces its row instead of losing the data.
    """
    reader = spark.readStream.schema(LOAD_PAYLOAD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        session = batch.sparkSession
        try:
            merge_batch(batch, root, batch_id, now)
        finally:
            row = live_prediction(session, root, weather(), model, now, steps_per_hour)
            row.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        reader.json(landing)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
