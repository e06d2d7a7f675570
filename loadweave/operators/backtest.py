"""Daily error metrics and walk-forward splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions.text import finite
from loadweave.functions.timeutil import day_floor, interval, naive


def daily_metrics(df: DataFrame, time: str, actual: str, forecast: str) -> DataFrame:
    """Per day: daily_mape_pct, daily_mae_mw, daily_rmse_mw, n; incomplete pairs are left out."""
    y, e = finite(actual), finite(forecast) - finite(actual)
    pairs = df.select(day_floor(time).alias("day"), y.alias("y"), e.alias("e")).where(F.col("e").isNotNull())
    return pairs.groupBy("day").agg(
        (F.avg(F.try_divide(F.abs("e"), F.abs("y"))) * 100).alias("daily_mape_pct"),
        F.avg(F.abs("e")).alias("daily_mae_mw"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("daily_rmse_mw"),
        F.count(F.lit(1)).alias("n"),
    )


def pooled_metrics(df: DataFrame, actual: str, forecast: str) -> DataFrame:
    """One row over all complete pairs: rmse, mae, mape (in percent), n."""
    y, e = finite(actual), finite(forecast) - finite(actual)
    pairs = df.select(y.alias("y"), e.alias("e")).where(F.col("e").isNotNull())
    return pairs.agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.abs("e")).alias("mae"),
        (F.avg(F.try_divide(F.abs("e"), F.abs("y"))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    )


def with_persistence(df: DataFrame, time: str, value: str, hours: int = 24, name: str = "forecast") -> DataFrame:
    """Adds the value ``hours`` earlier as forecast; times must be unique."""
    earlier = df.select((F.col(time) + interval(hours=hours)).alias(time), F.col(value).alias(name))
    return df.join(earlier, time, "left")


def walk_forward_folds(df: DataFrame, time: str, horizon_hours: int = 24) -> DataFrame:
    """One fold per day that has earlier data: bounds and row counts of both roles.

    Training takes all rows before the fold, testing the rows of the horizon.
    Counts come from running sums over the days, not from pairing rows and folds.
    """
    daily = df.groupBy(day_floor(time).alias("fold")).agg(F.count(F.lit(1)).alias("_rows"), F.min(time).alias("_first"))
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    tested = (
        walk_forward_roles(df, time, horizon_hours)
        .select(F.explode("test_folds").alias("fold"))
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("test_rows"))
    )
    folds = daily.withColumns({"train_rows": F.sum("_rows").over(before), "train_start": F.min("_first").over(before)})
    return (
        folds.where(F.col("train_rows") > 0)
        .join(tested, "fold", "left")
        .select(
            "fold",
            "train_start",
            F.col("fold").alias("train_end"),
            (F.col("fold") + interval(hours=horizon_hours)).alias("test_end"),
            "train_rows",
            F.coalesce("test_rows", F.lit(0)).alias("test_rows"),
        )
    )


def walk_forward_roles(df: DataFrame, time: str, horizon_hours: int = 24) -> DataFrame:
    """Adds to each row its roles: ``first_train_fold`` and ``test_folds``.

    A row trains every fold from ``first_train_fold`` on and is tested in
    ``test_folds`` (horizon / 24 of them). This states all (fold, role, row)
    triples in one row each; their number grows with the square of the days.
    """
    day = day_floor(time)
    reach = math.ceil(horizon_hours / 24)
    starts = F.array(*[day - interval(days=back) for back in range(reach - 1, -1, -1)])
    tests = F.filter(starts, lambda fold: F.col(time) < fold + interval(hours=horizon_hours))
    return df.withColumns({"first_train_fold": day + interval(days=1), "test_folds": tests})


def fold_rows(df: DataFrame, time: str, fold: str, horizon_hours: int = 24) -> DataFrame:
    """Rows of one fold with their role, as two filters on the time column."""
    start = naive(fold)
    role = F.when(F.col(time) < start, "train").otherwise("test")
    return df.where(F.col(time) < start + interval(hours=horizon_hours)).withColumn("role", role)
