"""From raw files to the hourly modeling table.

Each stage is one lazy plan that ends in a Parquet table; the next stage
starts from that table.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.operators.align import align_hourly, national_mean, resample_mean
from loadweave.operators.dedup import keep_first
from loadweave.operators.quality import load_continuity, weather_continuity
from loadweave.operators.report import finish_report, report_rows
from loadweave.operators.reshape import wide_years_to_long
from loadweave.session import stage
from loadweave.sources.files import FILE_ORDER, PLACE, listed_files, read_load_long, read_load_wide, read_weather, rejected_rows
from loadweave.sources.report_text import read_report_lines
from loadweave.sources.tables import write_parquet, write_years

NAMED = 20  # files that a warning names


def unique_load(load: DataFrame) -> DataFrame:
    """The first row per time over all files, in file order."""
    return keep_first(load, ["datetime"], FILE_ORDER).select("datetime", "load_mw")


def unique_load_per_file(load: DataFrame) -> DataFrame:
    """The first row per time within each file."""
    return keep_first(load, ["file", "path", "datetime"], FILE_ORDER).select("file", "path", "datetime", "load_mw")


def build_load_dataset(spark: SparkSession, paths: str | list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned load written to ``out``; returns it with the report, a line for every file.

    The report: continuity of the unique rows (file, rows, min_dt, max_dt, n_bad_steps),
    the path, and what the file had: rows_read, no_time, no_number, duplicates. The
    counts come from the stored rows that the dataset is made of.
    """
    raw = stage(read_load_long(spark, paths, keep_untimed=True), "load")
    timed = raw.where(F.col("datetime").isNotNull())
    write_parquet(unique_load(timed), out, sort="datetime")
    unique = stage(unique_load_per_file(timed).select("file", "path", "datetime"), "load-files")
    found = load_continuity(unique, file=("file", "path"), files=listed_files(spark, paths))
    counts = ["rows_read", "no_time", "no_number"]
    report = found.join(rejected_rows(raw), ["file", "path"], "left").fillna(0, counts)
    duplicates = (F.col("rows_read") - F.col("no_time") - F.col("rows")).alias("duplicates")
    shown = report.select("file", "rows", "min_dt", "max_dt", "n_bad_steps", "path", *counts, duplicates)
    return spark.read.parquet(out), shown.orderBy("file", "path")


def unique_weather(weather: DataFrame) -> DataFrame:
    """The first row per city and time, in file order."""
    order = [c for c in FILE_ORDER if c in weather.columns]
    return keep_first(weather, ["city", "datetime"], order).drop(*PLACE)


def build_weather_dataset(spark: SparkSession, paths: str | list[str], out: str) -> tuple[DataFrame, DataFrame]:
    """National hourly weather written to ``out``; returns it with the continuity report per city."""
    clean = stage(unique_weather(read_weather(spark, paths)), "weather")
    write_parquet(national_mean(clean), out, sort="datetime")
    return spark.read.parquet(out), weather_continuity(clean)


def hourly_dataset(load: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly load (empty hours null) joined with the weather of the same hour."""
    return align_hourly(resample_mean(load), weather)


def build_hourly_dataset(spark: SparkSession, load_path: str, weather_path: str, out: str) -> DataFrame:
    final = hourly_dataset(spark.read.parquet(load_path), spark.read.parquet(weather_path))
    write_parquet(final, out, sort="datetime")
    return spark.read.parquet(out)


def normalise_load_years(spark: SparkSession, root: str, years: str, out: str, step_minutes: int = 30, tz: str = "utc") -> list[int]:
    """Wide yearly load files to long CSV by year, all years in one plan; returns the years found."""
    frames = read_load_wide(spark, root, years)
    if frames:
        write_years(wide_years_to_long(frames, step_minutes, tz), out)
    return list(frames)


def reports_without_rows(spark: SparkSession, paths: str | list[str], rows: DataFrame) -> DataFrame:
    """path of every report that gave no row; rows: the long rows with their file."""
    listed = listed_files(spark, paths).select("path")
    return listed.join(rows.select(F.col("file").alias("path")).distinct(), "path", "left_anti").sort("path")


def normalise_reports(spark: SparkSession, paths: str | list[str], out: str, year: Column | int | None = None, tz: str = "utc") -> DataFrame:
    """Generation reports to long CSV by year; raises if no row was extracted, warns of files that gave none.

    Without a ``year`` it is the last four-digit number in the file name.
    """
    lines = stage(read_report_lines(spark, paths), "report")
    name_year = F.regexp_extract("file", r"^.*(\d{4})[^/]*$", 1).try_cast("int")
    rows = stage(report_rows(lines), "report-rows")
    long = stage(finish_report(rows, name_year if year is None else year, tz), "report-long")
    if long.isEmpty():
        raise ValueError(f"no rows extracted from {paths}")
    silent = reports_without_rows(spark, paths, rows)
    names = [r.path for r in silent.limit(NAMED + 1).collect()]
    if names:
        warnings.warn(f"no rows extracted from {', '.join(names[:NAMED])}{' and others' if len(names) > NAMED else ''}", stacklevel=2)
    write_years(long, out)
    return long
