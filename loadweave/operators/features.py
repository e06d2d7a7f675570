"""The feature contract and the tables that satisfy it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.calendar import calendar_columns, cyclic_columns
from loadweave.functions.timeutil import hour_floor, interval
from loadweave.operators.align import latest_row, nearest_row
from loadweave.operators.windows import history_features, lag_rows, roll_rows

# The model's feature names in their binding order.
WEATHER = ("temperature_2m", "wind_speed_10m", "direct_radiation", "diffuse_radiation", "cloud_cover")
CALENDAR = ("hour", "dayofweek", "is_weekend", "month", "dayofyear")
CYCLIC = ("hour_sin", "hour_cos", "doy_sin", "doy_cos")
HISTORY = (
    "load_lag_1h",
    "load_lag_24h",
    "load_lag_48h",
    "load_lag_168h",
    "load_roll_mean_24h",
    "load_roll_std_24h",
    "load_roll_mean_168h",
    "load_roll_std_168h",
)
FEATURES = (*WEATHER, *CALENDAR, *CYCLIC, *HISTORY)
TARGET = "load_mw"
# Declared features of the generation models.
WIND_FEATURES = ("wind_speed_10m", "hour_of_day", "day_of_year")
SOLAR_FEATURES = ("direct_radiation", "cloud_cover", "hour_of_day", "day_of_year")


class MissingFeatures(ValueError):
    def __init__(self, missing: list[str], extra: list[str]):
        super().__init__(f"missing features: {missing}; extra features: {extra}")
        self.missing, self.extra = missing, extra


def read_contract(spark: SparkSession, path: str) -> tuple[list[str], str | None]:
    """Feature names in binding order and the target from a JSON metadata file."""
    document = json.loads(spark.read.text(path, wholetext=True).first()[0])
    features = document.get("features") if isinstance(document, dict) else None
    if not isinstance(features, list) or not features or not all(isinstance(f, str) for f in features):
        raise ValueError(f"no feature list in {path}")
    return features, document.get("target")


def check_contract(df: DataFrame, features: Sequence[str] = FEATURES) -> list[str]:
    """Raises if a feature is missing; returns the columns outside the contract."""
    missing = [name for name in features if name not in df.columns]
    extra = [name for name in df.columns if name not in features]
    if missing:
        raise MissingFeatures(missing, extra)
    return extra


def ordered_features(df: DataFrame, features: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """The contract columns in contract order, after the columns to keep."""
    check_contract(df, features)
    return df.select(*keep, *features)


def contract_of_maps(df: DataFrame, features_map: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """Row form for name-to-value maps: adds missing_features and extra_features."""
    expected = F.array(*[F.lit(name) for name in features])
    given = F.map_keys(features_map)
    return df.withColumns({"missing_features": F.array_except(expected, given), "extra_features": F.array_except(given, expected)})


def features_from_maps(df: DataFrame, features_map: str, features: Sequence[str] = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """Complete maps as ordered columns; incomplete ones are left out (see contract_of_maps)."""
    checked = contract_of_maps(df, features_map, features).where(F.size("missing_features") == 0)
    return checked.select(*keep, *[F.col(features_map)[name].cast("double").alias(name) for name in features])


def with_calendar(df: DataFrame, time: str = "datetime") -> DataFrame:
    return df.withColumns({**calendar_columns(time), **cyclic_columns(time)})


def feature_table(
    load: DataFrame,
    weather: DataFrame,
    time: str = "datetime",
    value: str = TARGET,
    steps_per_hour: int = 2,
    series: Sequence[str] = (),
    plan: str = "chunks",
) -> DataFrame:
    """All features for every load time that has weather in its hour."""
    history = history_features(load, time, value, series, lag_rows(steps_per_hour), roll_rows(steps_per_hour), plan)
    hourly = weather.select(F.col(time).alias("_hour"), *WEATHER)
    joined = history.withColumn("_hour", hour_floor(time)).join(hourly, "_hour", "inner")
    return ordered_features(with_calendar(joined, "_hour"), FEATURES, [*series, time, value])


def cold_start(df: DataFrame, history_rows: Column, names: Sequence[str] = HISTORY) -> DataFrame:
    """0.0 for every history feature if there is no history at all; a short history stays null."""
    return df.withColumns({name: F.when(history_rows == 0, F.lit(0.0)).otherwise(F.col(name)) for name in names})


def live_features(
    history: DataFrame, weather: DataFrame, now, time: str = "datetime", value: str = TARGET, steps_per_hour: int = 2
) -> DataFrame:
    """One row: weather nearest to ``now`` with the features of the newest load row."""
    lags, rolls = lag_rows(steps_per_hour), roll_rows(steps_per_hour)
    look_back = max([*lags.values(), *rolls.values()]) + 1
    # Only the newest rows decide the newest features; the look-back is a fixed count.
    recent = history.select(time, value).orderBy(F.desc(time)).limit(look_back)
    newest = latest_row(history_features(recent, time, value, (), lags, rolls, plan="series"), time)
    row = nearest_row(weather, time, now).select(F.col(time), *WEATHER)
    joined = row.withColumn("_one", F.lit(1)).join(newest.select(*HISTORY).withColumn("_one", F.lit(1)), "_one", "left")
    rows = history.limit(1).agg(F.count(F.lit(1))).scalar()
    return ordered_features(with_calendar(cold_start(joined, rows), time), FEATURES, [time])


def horizon_features(df: DataFrame, time: str, value: str, horizon_hours: int = 24, steps_per_hour: int = 1) -> DataFrame:
    """Adds ``target``: the value ``horizon_hours`` later, matched on time, not on rows."""
    later = df.select((F.col(time) - interval(hours=horizon_hours)).alias(time), F.col(value).alias("target"))
    return df.join(later, time, "left")
