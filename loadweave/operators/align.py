"""National means, hourly resampling, joins and lookups along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.functions.schema import numeric_columns
from loadweave.functions.text import finite
from loadweave.functions.timeutil import day_floor, interval, naive, step_floor
from loadweave.operators.longseries import PIECE, carried, with_pieces
from loadweave.session import stage


def national_mean(df: DataFrame, time: str = "datetime", exclude: Sequence[str] = ("city",)) -> DataFrame:
    """Mean over all cities of every numeric column per time; nulls are skipped."""
    numeric = numeric_columns(df, (*exclude, time))
    if not numeric:
        raise ValueError("no numeric columns to average")
    return df.groupBy(time).agg(*[F.avg(finite(c)).alias(c) for c in numeric])


def city_weights(cities: DataFrame, population: str = "population", name: str = "weight") -> DataFrame:
    """Share of each city in the total population."""
    total = cities.agg(F.sum(population)).scalar()
    return cities.withColumn(name, F.col(population) / total)


def weighted_mean(
    df: DataFrame, weights: DataFrame, values: Sequence[str], time: str = "datetime", city: str = "city", weight: str = "weight"
) -> DataFrame:
    """Weighted national mean per time; weights of missing values do not count.

    City rows are first summed per (time, city), so the join meets at most one
    row per city and time and no city can dominate a task.
    """
    sums = {v: F.sum(finite(v)) for v in values}
    counts = {v: F.count(finite(v)) for v in values}
    reduced = df.groupBy(time, city).agg(
        *[e.alias(f"_s_{v}") for v, e in sums.items()], *[e.alias(f"_n_{v}") for v, e in counts.items()]
    )
    joined = reduced.join(weights.select(city, F.col(weight).alias("_w")), city)
    return joined.groupBy(time).agg(
        *[
            F.try_divide(F.sum(F.col("_w") * F.col(f"_s_{v}")), F.sum(F.col("_w") * F.col(f"_n_{v}"))).alias(v)
            for v in values
        ]
    )


def time_spine(bounds: DataFrame, low: str, high: str, name: str, minutes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every step from ``low`` to ``high``; days are expanded first, then steps within the day."""
    day = F.explode(F.sequence(day_floor(low), day_floor(high), interval(days=1))).alias("_day")
    days = bounds.where(F.col(low).isNotNull()).select(*keys, low, high, day)
    start = F.col("_day")
    end = start + interval(days=1) - interval(minutes=minutes)
    steps = days.select(*keys, low, high, F.explode(F.sequence(start, end, interval(minutes=minutes))).alias(name))
    return steps.where(F.col(name).between(F.col(low), F.col(high))).select(*keys, name)


def resample_mean(
    df: DataFrame, time: str = "datetime", value: str = "load_mw", minutes: int = 60, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean per step, labelled by its start; empty steps between first and last are null."""
    if 1440 % minutes:
        raise ValueError("steps must divide a day")
    steps = (
        df.where(F.col(time).isNotNull())
        .select(*keys, step_floor(time, minutes).alias(time), finite(value).alias(value))
        .groupBy(*keys, time)
        .agg(F.avg(value).alias(value))
    )
    bounds = steps.groupBy(*keys).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    return merge_on([*keys, time], steps, time_spine(bounds, "_low", "_high", time, minutes, keys)).select(*keys, time, value)


def align_hourly(load: DataFrame, weather: DataFrame, time: str = "datetime") -> DataFrame:
    """Hourly load with the weather of the same hour; hours without weather drop out."""
    return load.join(weather, time, "inner")


def merge_on(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Full outer join of tables that are unique on the keys and share no other column.

    As a union with one aggregation it takes one shuffle, null keys are equal,
    and no key can be hot.
    """
    rows = union_all(*frames)
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rows.columns if c not in keys])


def combine_first(new: DataFrame, old: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Union of keys; the new value where it is known, else the old one. Keys are unique on each side."""
    newer = new.select(key, *[F.col(v).alias(f"_new_{v}") for v in values])
    older = old.select(key, *[F.col(v).alias(f"_old_{v}") for v in values])
    return merge_on([key], newer, older).select(key, *[F.coalesce(f"_new_{v}", f"_old_{v}").alias(v) for v in values])


def nearest_row(df: DataFrame, time: str, moment) -> DataFrame:
    """The row nearest in time to a moment; of two equally near the earlier."""
    gap = F.abs((F.col(time) - naive(moment)).cast("interval second").cast("decimal(20,6)"))
    return df.withColumn("_gap", gap).orderBy("_gap", time).limit(1).drop("_gap")


def nearest_join(
    targets: DataFrame, lookup: DataFrame, target_time: str, lookup_time: str, pieces: int | None = None
) -> DataFrame:
    """Adds to each target the lookup row nearest in time; on a tie the earlier one.

    ``lookup_time`` must be unique. Distinct target times and lookup times are
    merged into one ordered series; the last lookup before and the first after
    each target are carried along it, whatever the gaps. Output: the target
    columns, then the lookup columns.
    """
    wanted = targets.where(F.col(target_time).isNotNull()).select(F.col(target_time).alias("t")).distinct()
    known = lookup.where(F.col(lookup_time).isNotNull()).select(F.col(lookup_time).alias("t"), F.col(lookup_time).alias("known"))
    merged = wanted.withColumn("known", F.lit(None).cast("timestamp_ntz")).withColumn("wanted", F.lit(True))
    merged = merged.unionByName(known.withColumn("wanted", F.lit(False)))
    series = merged.groupBy("t").agg(F.max("known").alias("known"), F.max("wanted").alias("wanted"))
    cut = with_pieces(stage(series, "times"), "t", pieces)
    lookup_at = F.col("known")
    between_known = carried(cut, "t", last={"below": lookup_at}, first={"above": lookup_at}).drop(PIECE)
    nearer = F.when(F.col("above").isNull() | (F.col("t") - F.col("below") <= F.col("above") - F.col("t")), F.col("below"))
    match = between_known.where("wanted").select(F.col("t").alias("_t"), nearer.otherwise(F.col("above")).alias("_match"))
    # The lookup rows meet the distinct times first, so the targets are joined once, on their own times.
    rows = match.join(lookup.withColumn("_match", F.col(lookup_time)), "_match").drop("_match")
    return targets.join(rows, F.col(target_time) == F.col("_t"), "left").select(*targets.columns, *lookup.columns)


def latest_row(df: DataFrame, time: str, series: Sequence[str] = ()) -> DataFrame:
    """The newest row, or the newest of each series."""
    if not series:
        return df.orderBy(F.desc(time)).limit(1)
    rest = [c for c in df.columns if c not in series]
    return df.groupBy(*series).agg(F.max_by(F.struct(*rest), time).alias("_r")).select(*series, "_r.*").select(*df.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column a frame lacks is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def retain(df: DataFrame, time: str, as_of, days: int = 10) -> DataFrame:
    """Rows later than ``as_of`` minus some days."""
    return df.where(F.col(time) > naive(as_of) - interval(days=days))
