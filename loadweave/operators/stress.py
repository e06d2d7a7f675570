"""Residual load, extreme demand and gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.functions.text import finite
from loadweave.functions.timeutil import interval
from loadweave.operators.align import merge_on, resample_mean
from loadweave.operators.longseries import PIECE, carried, exact_quantiles, with_pieces
from loadweave.session import stage


def residual_load(
    load: DataFrame,
    generation: DataFrame,
    time: str = "datetime",
    kind: str = "production_type",
    value: str = "value_mw",
    wind: str = "WIND",
    solar: str = "SOLAR",
) -> DataFrame:
    """Load minus wind minus solar; null where there is no generation row for the time."""
    sums = (
        generation.where(F.col(kind).isin(wind, solar))
        .groupBy(time)
        .agg(
            F.coalesce(F.sum(F.when(F.col(kind) == wind, F.col(value))), F.lit(0.0)).alias("wind_mw"),
            F.coalesce(F.sum(F.when(F.col(kind) == solar, F.col(value))), F.lit(0.0)).alias("solar_mw"),
        )
    )
    joined = load.join(sums, time, "left")
    return joined.withColumn("residual_mw", F.col("load_mw") - F.col("wind_mw") - F.col("solar_mw"))


def flag_extreme(df: DataFrame, value: str = "load_mw", share: float = 0.95, name: str = "is_extreme") -> DataFrame:
    """0/1 flag: value at or above its exact quantile over the whole table."""
    threshold = exact_quantiles(df, value, [share])[0]
    if threshold is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, (finite(value) >= threshold).cast("int"))


def fill_gaps(
    df: DataFrame, time: str = "datetime", value: str = "load_mw", minutes: int = 60, keys: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """Regular series with its holes filled; adds ``filled_from``.

    A missing step takes the value one week earlier; where that is missing too
    it is interpolated linearly between the nearest known values. Holes at the
    ends stay null.
    """
    grid = stage(resample_mean(df, time, value, minutes, keys), "hours")
    week = grid.select(*keys, (F.col(time) + interval(days=7)).alias(time), F.col(value).alias("_week"))
    merged = merge_on([*keys, time], grid.withColumn("_grid", F.lit(True)), week).where("_grid")
    known = merged.drop("_grid").withColumn("_known", F.coalesce(value, "_week"))
    cut = with_pieces(stage(known, "grid"), time, pieces)
    point = F.when(F.col("_known").isNotNull(), F.struct(F.col(time).alias("t"), F.col("_known").alias("v")))
    both = carried(cut, time, last={"_left": point}, first={"_right": point}, series=keys).drop(PIECE)

    def seconds(later, earlier):
        return (F.col(later) - F.col(earlier)).cast("interval second").cast("decimal(20,6)").cast("double")

    part = F.try_divide(seconds(time, "_left.t"), seconds("_right.t", "_left.t"))
    line = F.col("_left.v") + (F.col("_right.v") - F.col("_left.v")) * part
    source = F.when(F.col(value).isNotNull(), "observed").when(F.col("_week").isNotNull(), "last_week")
    return both.select(
        *keys,
        time,
        F.coalesce(value, "_week", line).alias(value),
        source.when(line.isNotNull(), "interpolated").alias("filled_from"),
    )
