"""Calendar and cyclic features, and the French public holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.functions.timeutil import col

# Public holidays of mainland France.
FIXED_HOLIDAYS = (
    ("new_year", "01-01"),
    ("labour_day", "05-01"),
    ("victory_1945", "05-08"),
    ("national_day", "07-14"),
    ("assumption", "08-15"),
    ("all_saints", "11-01"),
    ("armistice_1918", "11-11"),
    ("christmas", "12-25"),
)
EASTER_HOLIDAYS = (("easter_monday", 1), ("ascension", 39), ("whit_monday", 50))


def calendar_columns(ts: Column | str) -> dict[str, Column]:
    """hour, dayofweek (Monday 0), is_weekend, month, dayofyear."""
    t = col(ts)
    weekday = F.weekday(t)
    return {
        "hour": F.hour(t),
        "dayofweek": weekday,
        "is_weekend": F.when(weekday >= 5, 1).otherwise(0),
        "month": F.month(t),
        "dayofyear": F.dayofyear(t),
    }


def cyclic_columns(ts: Column | str) -> dict[str, Column]:
    """Sine and cosine of the hour (period 24) and of the day of year (period 366)."""
    t = col(ts)
    hour = F.hour(t) * F.lit(2 * math.pi) / F.lit(24.0)
    day = F.dayofyear(t) * F.lit(2 * math.pi) / F.lit(366.0)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "doy_sin": F.sin(day), "doy_cos": F.cos(day)}


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, holiday) for each public holiday; Easter by the Gregorian computus."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    golden = years.selectExpr("y", "y % 19 as g", "y div 100 as c", "y % 100 as r")
    moon = golden.selectExpr(
        "y", "g", "c", "r",
        "(19 * g + c - c div 4 - (c - (c + 8) div 25 + 1) div 3 + 15) % 30 as epact",
    )
    week = moon.selectExpr("y", "g", "epact", "(32 + 2 * (c % 4) + 2 * (r div 4) - epact - r % 4) % 7 as shift")
    easter = week.selectExpr(
        "y",
        "cast(date_add(make_date(y, 3, 22),"
        " cast(epact + shift - 7 * ((g + 11 * epact + 22 * shift) div 451) as int)) as date) as easter",
    )
    dated = [
        F.struct(F.lit(name).alias("holiday"), F.concat_ws("-", F.col("y").cast("string"), F.lit(day)).cast("date").alias("day"))
        for name, day in FIXED_HOLIDAYS
    ]
    dated += [F.struct(F.lit(name).alias("holiday"), F.date_add("easter", lag).alias("day")) for name, lag in EASTER_HOLIDAYS]
    listed = easter.select(F.explode(F.array(*dated)).alias("h")).select("h.day", "h.holiday")
    # Ascension can fall on a fixed holiday; one row per day keeps the lookup one to one.
    return listed.groupBy("day").agg(F.min("holiday").alias("holiday"))


def with_holiday_flag(df: DataFrame, ts: str, holidays: DataFrame) -> DataFrame:
    """0/1 ``is_holiday`` by a left lookup on the day; the table has some 11 rows per year."""
    days = holidays.select(F.col("day").alias("_day"), F.lit(1).alias("_hit")).dropDuplicates(["_day"])
    joined = df.join(days, F.col(ts).cast("date") == F.col("_day"), "left")
    return joined.withColumn("is_holiday", F.coalesce("_hit", F.lit(0))).drop("_day", "_hit")
