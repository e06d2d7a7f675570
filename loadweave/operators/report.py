"""Generation reports: text blocks per day to (hour, technology) rows.

Input lines are (file, line, cells): ``line`` counts the non-blank lines of a
file from 0. A file of any size is processed in chunks of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadweave.functions.text import (
    HOUR_WORD,
    NO_LABEL,
    date_text,
    hour_interval,
    hour_position,
    interval_start_minutes,
    is_date_line,
    is_header_line,
    report_number,
    strip,
    unique_labels,
)
from loadweave.functions.timeutil import interval, parse_day, utc_from_local
from loadweave.operators.dedup import REPORT_KEY, mean_per_key
from loadweave.operators.longseries import carried, with_halo

HEADER_REACH = 9
LINES_PER_CHUNK = 50_000


def mark_lines(lines: DataFrame) -> DataFrame:
    """Adds is_date, day (null if it does not parse) and is_header."""
    text = F.lower(F.concat_ws(" ", F.transform("cells", strip)))
    return (
        lines.withColumn("_text", text)
        .withColumns({"is_date": is_date_line("_text"), "day": parse_day(date_text("_text")), "is_header": is_header_line("_text")})
        .drop("_text")
    )


def assign_blocks(lines: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Data lines with the day and the header of their block.

    A date line takes the first header line among the next nine; of several
    date lines with the same header the earliest counts. A block runs from its
    header to the next date line. A date line that is at the same time the
    header of an earlier date line also opens a block of its own.

    Output: file, line, cells, day, header (unique labels), hour_pos.
    """
    marked = with_halo(mark_lines(lines), "line", lines_per_chunk, before=HEADER_REACH)
    w = Window.partitionBy("file", "_chunk").orderBy("line")
    next_header = F.min(F.when(F.col("is_header"), F.col("line"))).over(w.rowsBetween(1, HEADER_REACH))
    ahead = marked.withColumn("_next", F.when(F.col("day").isNotNull(), next_header))
    # Among the nine lines before a header, the dates that lead to it have the
    # largest next-header number; of these the earliest is wanted.
    dated = F.when(F.col("_next").isNotNull(), F.struct((-F.col("_next")).alias("to"), F.col("line"), F.col("day")))
    opened = ahead.withColumn("_date", F.min(dated).over(w.rowsBetween(-HEADER_REACH, -1))).where(~F.col("_halo"))
    used = F.col("is_header") & (-F.col("_date.to") == F.col("line"))
    marker = F.when(
        F.coalesce(used, F.lit(False)),
        F.struct(
            F.lit(True).alias("opens"),
            F.col("_date.day").alias("day"),
            unique_labels("cells").alias("header"),
            hour_position("cells").alias("hour_pos"),
        ),
    ).when(
        F.col("is_date"),
        F.struct(
            F.lit(False).alias("opens"),
            F.lit(None).cast("timestamp_ntz").alias("day"),
            F.lit(None).cast("array<string>").alias("header"),
            F.lit(None).cast("int").alias("hour_pos"),
        ),
    )
    placed = carried(opened, "line", {"_block": marker}, series=["file"], piece="_chunk", inclusive=False)
    return placed.where(F.col("_block.opens") & ~F.col("is_date")).select(
        "file", "line", "cells", "_block.day", "_block.header", "_block.hour_pos"
    )


def keep_hour_rows(blocks: DataFrame) -> DataFrame:
    """Lines with an hour interval in the expected cell or else in any; adds hour_interval."""
    cells = F.transform("cells", strip)
    found = blocks.withColumn("cells", cells).withColumn("hour_interval", hour_interval("cells", "hour_pos"))
    return found.where(F.col("hour_interval").isNotNull())


def is_value_column(label: Column, position: Column, hour_pos: Column) -> Column:
    """False for the hour column and for unnamed columns."""
    low = F.lower(label)
    return ~(low.contains(HOUR_WORD) | low.contains(NO_LABEL.lower()) | (position == hour_pos))


def rows_to_long(rows: DataFrame) -> DataFrame:
    """One row per technology: datetime (local), date, hour_interval, technology, value_mw."""
    pairs = F.arrays_zip(F.col("header").alias("technology"), F.col("cells").alias("cell"))
    start = F.col("day") + interval(minutes=interval_start_minutes("hour_interval"))
    exploded = rows.select("*", F.posexplode(pairs).alias("position", "pair")).where(
        (F.col("position") < F.size("header")) & is_value_column(F.col("pair.technology"), F.col("position"), F.col("hour_pos"))
    )
    return exploded.select(
        "file",
        start.alias("datetime"),
        F.col("day").alias("date"),
        "hour_interval",
        F.col("pair.technology").alias("technology"),
        report_number("pair.cell").alias("value_mw"),
    )


def report_to_long(lines: DataFrame, year: Column | int, tz: str = "utc", lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Complete normaliser: datetime, date, year, hour_interval, technology, value_mw (see finish_report)."""
    return finish_report(report_rows(lines, lines_per_chunk), year, tz)


def report_rows(lines: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """The long rows of report lines in local time, with their file."""
    return rows_to_long(keep_hour_rows(assign_blocks(lines, lines_per_chunk)))


def finish_report(rows: DataFrame, year: Column | int, tz: str = "utc") -> DataFrame:
    """``tz="utc"`` converts from local time, drops rows without a valid or unique instant and averages repeated keys.

    ``tz="local"`` keeps all rows as read. ``year`` is a constant or an expression on ``file``.
    """
    long = rows.withColumn("year", year if isinstance(year, Column) else F.lit(year))
    columns = [*REPORT_KEY, "value_mw"]
    if tz == "local":
        return long.select(*columns)
    utc = long.withColumns({"datetime": utc_from_local("datetime"), "date": utc_from_local("date")})
    return mean_per_key(utc.where(F.col("datetime").isNotNull()).select(*columns), REPORT_KEY, "value_mw")
