"""Continuity reports and coverage summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions.timeutil import interval
from loadweave.operators.longseries import KEY, over_pieces, with_key, with_pieces


def continuity(
    df: DataFrame, time: str, series: Sequence[str], expected: Column, pieces: int | None = None
) -> DataFrame:
    """Per series: rows, min_dt, max_dt and the count of steps other than ``expected``.

    Steps inside a piece are counted there; the step between two pieces follows
    from the last time of one and the first of the next, on the summary table.
    """
    tagged = with_pieces(df.select(*series, time), time, pieces)
    tagged = with_key(tagged, series)
    within = Window.partitionBy(KEY).orderBy(time)
    stepped = tagged.withColumn("_step", F.col(time) - F.lag(time).over(within))
    bad = F.count(F.when(F.col("_step") != expected, 1))
    parts = stepped.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("min_dt"), F.max(time).alias("max_dt"), bad.alias("_bad")
    )
    between = F.col("min_dt") - F.lag("max_dt").over(over_pieces(series))
    linked = parts.withColumn("_joint", F.when(between != expected, 1).otherwise(0))
    names = [F.col(f"{KEY}.{name}").alias(name) for name in series]
    return linked.groupBy(*names).agg(
        F.sum("rows").alias("rows"),
        F.min("min_dt").alias("min_dt"),
        F.max("max_dt").alias("max_dt"),
        F.sum(F.col("_bad") + F.col("_joint")).alias("n_bad_steps"),
    )


def load_continuity(df: DataFrame, time: str = "datetime", file: str | Sequence[str] = "file", pieces: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """Half-hour continuity per file; files of the given list that have no row get a line with 0 rows.

    file: the column or columns that tell files apart, such as name and path.
    """
    keys = [file] if isinstance(file, str) else list(file)
    found = continuity(df, time, keys, interval(minutes=30), pieces)
    if files is not None:
        found = files.select(*keys).join(found, keys, "left").fillna(0, ["rows", "n_bad_steps"])
    return found.orderBy(*keys)


def weather_continuity(df: DataFrame, time: str = "datetime", city: str = "city", pieces: int | None = None) -> DataFrame:
    """Hourly continuity per city, worst first."""
    return continuity(df, time, [city], interval(hours=1), pieces).orderBy(F.desc("n_bad_steps"), city)


def coverage(df: DataFrame, time: str, entity: str | None = None, kind: str | None = None) -> DataFrame:
    """One row: rows, min_dt, max_dt, repeated times, distinct entities, sorted kinds.

    Rows are first reduced to distinct (time, entity, kind) with their count, so
    the distinct counts work on the reduced table. ``kinds`` lists every kind,
    as the report wants; a kind is a short label such as a production type.
    """
    names = {"_t": time, "_e": entity, "_k": kind}
    present = {alias: F.col(name).alias(alias) for alias, name in names.items() if name}
    reduced = df.select(*present.values()).groupBy(*present).agg(F.count(F.lit(1)).alias("_n"))
    measures = [
        F.sum("_n").alias("rows"),
        F.min("_t").alias("min_dt"),
        F.max("_t").alias("max_dt"),
        (F.sum("_n") - F.count_distinct("_t") - F.max(F.when(F.col("_t").isNull(), 1).otherwise(0))).alias("duplicate_times"),
    ]
    if entity:
        measures.append(F.count_distinct("_e").alias("entities"))
    if kind:
        measures.append(F.array_sort(F.collect_set("_k")).alias("kinds"))
    return reduced.agg(*measures)
