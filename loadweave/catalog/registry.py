"""Query registry, the roles of the given tables, and shared SQL pieces."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.timeutil import hour_floor, step_floor


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under a name."""

    def register(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as meter readings: event_id, datetime, city, technology, load_mw."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("datetime"),
        (F.col("user_id") % 32).cast("int").alias("city"),
        F.col("event_type").alias("technology"),
        F.col("value").alias("load_mw"),
    )


READINGS = """
  (SELECT event_id, ts AS datetime, CAST(user_id % 32 AS INTEGER) AS city,
          event_type AS technology, value AS load_mw FROM events)
"""


# Factors without a short decimal form, so that rounded means are never ties.
SCALES = (0.7071067811865476, 0.0577350269189626, 2.23606797749979)


def weather_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as city weather with the five variables."""
    e = table(spark, folder, "events")
    return e.select(
        "event_id",
        F.col("ts").alias("datetime"),
        (F.col("user_id") % 32).cast("int").alias("city"),
        (F.col("value") * SCALES[0]).alias("temperature_2m"),
        ((F.col("user_id") % 17) + F.col("value") * SCALES[1]).alias("wind_speed_10m"),
        (F.col("value") * SCALES[2]).alias("direct_radiation"),
        (F.col("event_id") % 101).cast("double").alias("diffuse_radiation"),
        ((F.col("user_id") % 11) * 10).cast("double").alias("cloud_cover"),
    )


WEATHER_ROWS = f"""
  (SELECT event_id, ts AS datetime, CAST(user_id % 32 AS INTEGER) AS city, value * CAST({SCALES[0]} AS DOUBLE) AS temperature_2m,
          (user_id % 17) + value * CAST({SCALES[1]} AS DOUBLE) AS wind_speed_10m, value * CAST({SCALES[2]} AS DOUBLE) AS direct_radiation,
          CAST(event_id % 101 AS DOUBLE) AS diffuse_radiation,
          CAST((user_id % 11) * 10 AS DOUBLE) AS cloud_cover FROM events)
"""
VARIABLES = ("temperature_2m", "wind_speed_10m", "direct_radiation", "diffuse_radiation", "cloud_cover")


def hourly_weather(spark: SparkSession, folder: str) -> DataFrame:
    """National hourly weather: the mean of each variable per hour."""
    w = weather_rows(spark, folder)
    return w.groupBy(hour_floor("datetime").alias("datetime")).agg(*[F.avg(v).alias(v) for v in VARIABLES])


HOURLY_WEATHER = f"""
  (SELECT date_trunc('hour', datetime) AS datetime, {", ".join(f"avg({v}) AS {v}" for v in VARIABLES)}
   FROM {WEATHER_ROWS} GROUP BY 1)
"""


def half_hour_load(spark: SparkSession, folder: str) -> DataFrame:
    """One load value per half hour that has readings."""
    r = readings(spark, folder)
    scaled = F.col("load_mw") * SCALES[0]
    return r.groupBy(step_floor("datetime", 30).alias("datetime")).agg(F.avg(scaled).alias("load_mw"))


HALF_HOUR_LOAD = f"""
  (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS datetime, avg(value * CAST({SCALES[0]} AS DOUBLE)) AS load_mw FROM events GROUP BY 1)
"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def microseconds(step: Column) -> Column:
    """Day-time interval to whole microseconds."""
    return (step.cast("interval second").cast("decimal(20,6)") * 1000000).cast("long")


def paris_to_utc(t: str) -> str:
    """SQL for local Paris wall time to UTC by the rule in force since 1996."""

    def last_sunday(month: int) -> str:
        day = f"make_date(CAST(year({t}) AS BIGINT), {month}, 31)"
        return f"({day} - CAST(isodow({day}) % 7 AS INTEGER))"

    spring, autumn = last_sunday(3), last_sunday(10)
    return f"""CASE
      WHEN {t} >= {spring} + INTERVAL 2 HOUR AND {t} < {spring} + INTERVAL 3 HOUR THEN {spring} + INTERVAL 1 HOUR
      WHEN {t} >= {autumn} + INTERVAL 2 HOUR AND {t} < {autumn} + INTERVAL 3 HOUR THEN NULL
      WHEN {t} >= {spring} + INTERVAL 3 HOUR AND {t} < {autumn} + INTERVAL 2 HOUR THEN {t} - INTERVAL 2 HOUR
      ELSE {t} - INTERVAL 1 HOUR END"""


# The five event types, as technologies in name order.
TECHNOLOGIES = ("click", "error", "purchase", "signup", "view")
