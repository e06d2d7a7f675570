"""Slot numbers, steps, row lags and rolling statistics along time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions.text import finite
from loadweave.operators.align import resample_mean
from loadweave.operators.longseries import PIECE, carried, number_rows, with_halo, with_pieces
from loadweave.session import stage

# Look-backs in hours of the feature contract.
LAG_HOURS = (1, 24, 48, 168)
ROLL_HOURS = (24, 168)


def lag_rows(steps_per_hour: int = 2, hours: Sequence[int] = LAG_HOURS) -> dict[str, int]:
    return {f"load_lag_{h}h": h * steps_per_hour for h in hours}


def roll_rows(steps_per_hour: int = 2, hours: Sequence[int] = ROLL_HOURS) -> dict[str, int]:
    return {f"{h}h": h * steps_per_hour for h in hours}


def previous_time(df: DataFrame, time: str, series: Sequence[str] = (), name: str = "previous", pieces: int | None = None) -> DataFrame:
    """Adds the time of the row before, per series (none: the whole table)."""
    tagged = with_pieces(df, time, pieces)
    return carried(tagged, time, {name: F.col(time)}, series=series, inclusive=False).drop(PIECE)


def step_to_previous(df: DataFrame, time: str, series: Sequence[str] = (), name: str = "step", pieces: int | None = None) -> DataFrame:
    """Adds the interval since the row before; null on the first row of a series."""
    return (
        previous_time(df, time, series, "_previous", pieces)
        .withColumn(name, F.col(time) - F.col("_previous"))
        .drop("_previous")
    )


def history_features(
    df: DataFrame,
    time: str,
    value: str,
    series: Sequence[str] = (),
    lags: Mapping[str, int] | None = None,
    rolls: Mapping[str, int] | None = None,
    plan: str = "chunks",
    chunk: int | None = None,
    pieces: int | None = None,
    mode: str = "rows",
    step_minutes: int = 30,
) -> DataFrame:
    """Row lags, rolling means and rolling sample deviations of a series.

    ``lags`` maps names to row counts, ``rolls`` maps suffixes to window sizes.
    A rolling value is null until its window is full and while a null is in it.
    ``mode="rows"`` counts rows as they are, gaps or not; ``mode="time"`` first
    brings each series to a regular grid of ``step_minutes`` (columns: series,
    time, value), so that a number of rows is a duration.
    ``plan="chunks"`` works on numbered chunks with a halo and suits series of
    any length; it reads its input several times, so pass a stored table (see
    ``session.stage``). ``plan="series"`` gives each series to one task and suits many
    short ones.
    """
    lags = lag_rows() if lags is None else lags
    rolls = roll_rows() if rolls is None else rolls
    if mode == "time":
        df = stage(resample_mean(df, time, value, step_minutes, series), "grid")
    clean = df.withColumn(value, finite(value))
    if plan == "series":
        w = Window.partitionBy(*series).orderBy(time)
        columns = {name: F.lag(value, n).over(w) for name, n in lags.items()}
        for suffix, n in rolls.items():
            frame = w.rowsBetween(-(n - 1), 0)
            full = F.count(value).over(frame) == n
            columns[f"load_roll_mean_{suffix}"] = F.when(full, F.avg(value).over(frame))
            columns[f"load_roll_std_{suffix}"] = F.when(full, F.stddev_samp(value).over(frame))
        return clean.withColumns(columns)
    back = max([*lags.values(), *rolls.values(), 1])
    numbered = number_rows(clean, time, series, "_row", pieces)
    pieced = with_halo(numbered, "_row", chunk or max(4096, 8 * back), before=back)
    w = Window.partitionBy(*series, "_chunk").orderBy("_row")
    return (
        _by_running_sums(pieced, value, w, lags, rolls)
        .where(~F.col("_halo"))
        .drop("_row", "_chunk", "_halo")
    )


def _by_running_sums(df: DataFrame, value: str, w, lags: Mapping[str, int], rolls: Mapping[str, int]) -> DataFrame:
    """Rolling statistics as differences of running sums.

    A sliding frame touches every row of the window again for each output row;
    a running sum costs the same for any window size. Values are taken relative
    to the first one of the chunk to keep the squares small, and a count of
    changes makes the deviation of a constant window exactly zero.
    """
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    columns = {name: F.lag(value, n).over(w) for name, n in lags.items()}
    if not rolls:
        return df.withColumns(columns)
    columns["_base"] = F.coalesce(F.first(value, ignorenulls=True).over(upto), F.lit(0.0))
    columns["_before"] = F.lag(value, 1).over(w)
    based = df.withColumns(columns)
    gap = F.coalesce(F.col(value) - F.col("_base"), F.lit(0.0))
    changed = F.when(F.col(value).eqNullSafe(F.col("_before")), 0).otherwise(1)
    summed = based.withColumns(
        {
            "_n": F.count(value).over(upto),
            "_s": F.sum(gap).over(upto),
            "_q": F.sum(gap * gap).over(upto),
            "_moves": F.sum(changed).over(upto),
        }
    )
    frames = {}
    for suffix, n in rolls.items():
        for part, default in (("_n", 0), ("_s", 0.0), ("_q", 0.0)):
            frames[f"{part}_{suffix}"] = F.col(part) - F.coalesce(F.lag(part, n).over(w), F.lit(default))
        frames[f"_m_{suffix}"] = F.col("_moves") - F.lag("_moves", n - 1).over(w)
    framed = summed.withColumns(frames)
    out = {}
    for suffix, n in rolls.items():
        full = F.col(f"_n_{suffix}") == n
        s, q = F.col(f"_s_{suffix}"), F.col(f"_q_{suffix}")
        spread = F.greatest(q - s * s / n, F.lit(0.0))
        out[f"load_roll_mean_{suffix}"] = F.when(full, F.col("_base") + s / n)
        deviation: Column = F.when(F.col(f"_m_{suffix}") == 0, F.lit(0.0)).otherwise(F.sqrt(spread / (n - 1)))
        out[f"load_roll_std_{suffix}"] = F.when(full & F.lit(n > 1), deviation)
    return framed.withColumns(out).drop("_base", "_before", "_n", "_s", "_q", "_moves", *frames)
