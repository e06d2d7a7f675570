"""Wide daily load files to long half-hour rows.

Columns count by position, whatever their names: date, status, then one column per
slot. The slots of a row travel as one array, so files of unlike width share a plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadweave.functions.text import finite, number
from loadweave.functions.timeutil import parse_day, slot_timestamp, utc_from_local
from loadweave.operators.dedup import LOAD_FILE_KEY, mean_per_key
from loadweave.operators.longseries import number_rows

ROW = "_row"
CELLS = "_cells"


def _value(df: DataFrame, name: str) -> Column:
    return finite(number(F.trim(name)) if isinstance(df.schema[name].dataType, T.StringType) else name)


def unpivot_slots(df: DataFrame, ids: list[str], slots: list[str]) -> DataFrame:
    """One row per slot column as (slot_col, load_mw); null values stay."""
    values = df.select(*ids, *[_value(df, s).alias(s) for s in slots])
    return values.unpivot(ids, slots, "slot_col", "load_mw")


def slot_cells(df: DataFrame, slots: list[str]) -> Column:
    """The slot columns of a row as an array of (filled, load_mw); filled: there was a value, a number or not."""
    return F.array(*[F.struct(F.col(s).isNotNull().alias("filled"), _value(df, s).alias("load_mw")) for s in slots])


def pack_year(df: DataFrame, year: int) -> DataFrame:
    """Rows with a date as year, date, statut, _row, _cells; a ``_row`` column gives the order, else the content does."""
    names = [name if name == ROW else f"_at_{i}" for i, name in enumerate(df.columns)]
    day, *rest = [name for name in names if name != ROW]
    if len(rest) < 2:
        raise ValueError(f"no time-step columns in {year}")
    rows = df.toDF(*names)
    text = isinstance(rows.schema[day].dataType, T.StringType)
    date = parse_day(day) if text else F.col(day).cast("date").cast("timestamp_ntz")
    order = F.col(ROW) if ROW in names else F.xxhash64(day, *rest)
    status, *slots = rest
    packed = rows.select(F.lit(year).alias("year"), date.alias("date"), F.col(status).cast("string").alias("statut"), order.alias(ROW), slot_cells(rows, slots).alias(CELLS))
    return packed.where(F.col("date").isNotNull())


def used_positions(days: DataFrame) -> DataFrame:
    """year, _used: ascending positions of the slots that have a value on some day of the year."""
    filled = days.select("year", F.posexplode(F.col(f"{CELLS}.filled")).alias("_at", "_filled")).where("_filled")
    return filled.select("year", "_at").distinct().groupBy("year").agg(F.sort_array(F.collect_list("_at")).alias("_used"))


def number_slots(days: DataFrame) -> DataFrame:
    """Packed days as year, date, statut, slot_index, load_mw; slots without a value in the whole year are left out.

    slot_index: 0-based order within the year and date by slot, then source row. It is
    known before the arrays are opened: slot ``p`` of copy ``r`` among the ``m`` rows of
    a date comes at ``p * m + r``. Only the short wide rows are ranked, and only where a
    date has several rows at all, which one aggregation over all years tells.
    """
    copies = days.groupBy("year", "date").agg(F.count(F.lit(1)).alias("_copies"))
    most = copies.agg(F.max("_copies")).first()[0] or 1
    if most == 1:
        ranked = days.withColumns({"_rank": F.lit(0), "_copies": F.lit(1)})
    else:
        ranked = number_rows(days, ROW, ["year", "date"], "_rank").join(copies, ["year", "date"])
    used = ranked.join(used_positions(days), "year")
    values = F.transform("_used", lambda at: F.get(F.col(f"{CELLS}.load_mw"), at))
    long = used.select("year", "date", "statut", "_rank", "_copies", F.posexplode(values).alias("_slot", "load_mw"))
    return long.select("year", "date", "statut", (F.col("_slot") * F.col("_copies") + F.col("_rank")).cast("int").alias("slot_index"), "load_mw")


def wide_years_to_long(frames: dict[int, DataFrame], step_minutes: int = 30, tz: str = "utc") -> DataFrame:
    """Normalises yearly wide files of any widths in one plan; frames: by year.

    Output: datetime, date, year, statut, slot_index, load_mw. ``tz="utc"``
    converts from local time, drops slots whose wall time is ambiguous and
    averages repeated keys; ``tz="local"`` keeps wall times as they are. A
    ``_row`` column, where present, gives the order of rows with equal dates.
    A year without a date or a value gives no rows. The number of Spark jobs does not
    depend on the number of years.
    """
    if not frames:
        raise ValueError("no yearly frames")
    days = reduce(DataFrame.unionByName, [pack_year(df, year) for year, df in frames.items()])
    long = number_slots(days)
    local = slot_timestamp("date", "slot_index", step_minutes)
    if tz == "local":
        timed = long.withColumn("datetime", local)
    else:
        timed = long.withColumns({"datetime": utc_from_local(local), "date": utc_from_local("date")})
        timed = timed.where(F.col("datetime").isNotNull())
    out = timed.select("datetime", "date", "year", "statut", "slot_index", "load_mw")
    return out if tz == "local" else mean_per_key(out, LOAD_FILE_KEY, "load_mw")


def wide_to_long(df: DataFrame, year: int, step_minutes: int = 30, tz: str = "utc") -> DataFrame:
    """Normalises one yearly wide file as ``wide_years_to_long`` does."""
    return wide_years_to_long({year: df}, step_minutes, tz)
