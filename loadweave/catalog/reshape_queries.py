"""Wide files and generation reports built from events, then normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.catalog.registry import TECHNOLOGIES, paris_to_utc, query, rounded, table
from loadweave.functions.timeutil import day_floor, interval
from loadweave.operators.report import assign_blocks, keep_hour_rows, report_to_long, rows_to_long
from loadweave.operators.reshape import unpivot_slots, wide_to_long
from loadweave.session import stage

HOURS = range(24)
SHIFT_DAYS = 70  # moves January over the March clock change


def wide_days(spark, folder, shift: int = SHIFT_DAYS) -> DataFrame:
    """One row per day: date text, status, then the mean of each hour."""
    e = table(spark, folder, "events").withColumn("t", F.col("ts") + interval(days=shift))
    hours = [F.avg(F.when(F.hour("t") == h, F.col("value"))).alias(f"h{h:02d}") for h in HOURS]
    return e.groupBy(F.date_format("t", "dd/MM/yyyy").alias("day"), F.lit("D").alias("status")).agg(*hours)


HOURLY_SQL = f"""
  (SELECT day, hour, slot.v AS load_mw FROM (
     SELECT CAST(ts + INTERVAL {SHIFT_DAYS} DAY AS DATE) AS day FROM events GROUP BY 1)
   CROSS JOIN (SELECT unnest(range(24)) AS hour) h
   LEFT JOIN (SELECT CAST(ts + INTERVAL {SHIFT_DAYS} DAY AS DATE) AS d, hour(ts) AS hh, avg(value) AS v FROM events GROUP BY 1, 2) slot
     ON slot.d = day AND slot.hh = hour)
"""


@query(
    "wide_unpivot",
    f"SELECT strftime(day, '%d/%m/%Y') AS day, 'h' || lpad(CAST(hour AS VARCHAR), 2, '0') AS slot_col, round(load_mw, 6) AS load_mw FROM {HOURLY_SQL}",
)
def wide_unpivot(spark, folder):
    return rounded(unpivot_slots(wide_days(spark, folder), ["day"], [f"h{h:02d}" for h in HOURS]), "load_mw")


@query(
    "wide_to_long_utc",
    f"""SELECT datetime, {paris_to_utc('day')} AS date, 2024 AS year, 'D' AS statut, slot_index, round(load_mw, 6) AS load_mw
        FROM (SELECT {paris_to_utc('t')} AS datetime, day, slot_index, load_mw FROM (
          SELECT day + to_hours(CAST(hour AS INTEGER)) AS t, day + INTERVAL 0 DAY AS day, CAST(hour AS INTEGER) AS slot_index, load_mw FROM {HOURLY_SQL}))
        WHERE datetime IS NOT NULL""",
)
def wide_to_long_utc(spark, folder):
    return rounded(wide_to_long(stage(wide_days(spark, folder), "wide"), 2024, step_minutes=60), "load_mw")


@query(
    "wide_to_long_local",
    f"""SELECT day + to_hours(CAST(hour AS INTEGER)) AS datetime, day + INTERVAL 0 DAY AS date, 2024 AS year, 'D' AS statut,
               CAST(hour AS INTEGER) AS slot_index, round(load_mw, 6) AS load_mw FROM {HOURLY_SQL}""",
)
def wide_to_long_local(spark, folder):
    return rounded(wide_to_long(stage(wide_days(spark, folder), "wide"), 2024, step_minutes=60, tz="local"), "load_mw")


def report_rows(spark, folder) -> DataFrame:
    """Report lines as (day, number within the day, text): date, header, one per hour."""
    e = table(spark, folder, "events").withColumn("t", F.col("ts") + interval(days=SHIFT_DAYS))
    hours = e.groupBy(day_floor("t").alias("day"), F.hour("t").alias("hour")).agg(
        *[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in TECHNOLOGIES]
    )
    cells = [F.when(F.col(k) == 0, "-").otherwise(F.concat(F.col(k).cast("string"), F.lit(",5"))) for k in TECHNOLOGIES]
    label = F.format_string("%02d:00-%02d:00", F.col("hour"), F.col("hour") + 1)
    rows = hours.select("day", (F.col("hour") + 2).alias("number"), F.concat_ws(";", label, *cells).alias("text"))
    days = e.select(day_floor("t").alias("day")).distinct()
    title = F.concat(F.lit("Données de réalisation du "), F.date_format("day", "dd/MM/yyyy"), F.lit(";" * len(TECHNOLOGIES)))
    header = F.lit(";".join(["Heures", *TECHNOLOGIES]))
    heads = days.select("day", F.explode(F.array(F.struct(F.lit(0).alias("number"), title.alias("text")), F.struct(F.lit(1).alias("number"), header.alias("text")))).alias("l"))
    return rows.unionByName(heads.select("day", "l.*"))


def report_lines(spark, folder) -> DataFrame:
    """The same lines as read from one file per week."""
    epoch_day = F.unix_date(F.col("day").cast("date"))
    return report_rows(spark, folder).select(
        F.concat(F.lit("week-"), F.floor(epoch_day / 7).cast("string")).alias("file"),
        ((epoch_day % 7) * 26 + F.col("number")).cast("long").alias("line"),
        F.split("text", ";").alias("cells"),
    )


COUNTS_SQL = f"""
  (SELECT CAST(ts + INTERVAL {SHIFT_DAYS} DAY AS DATE) + INTERVAL 0 DAY AS day, CAST(hour(ts) AS INTEGER) AS hour, {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in TECHNOLOGIES)}
   FROM events GROUP BY 1, 2)
"""
_LABEL = "lpad(CAST(hour AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(hour + 1 AS VARCHAR), 2, '0') || ':00'"
LONG_SQL = f"""
  (SELECT day, hour, {_LABEL} AS hour_interval, technology, CASE WHEN n = 0 THEN 0.0 ELSE n + 0.5 END AS value_mw
   FROM (UNPIVOT {COUNTS_SQL} ON {", ".join(TECHNOLOGIES)} INTO NAME technology VALUE n))
"""


@query("report_blocks", f"SELECT day, 2 + hour AS line_in_day, {_LABEL} AS hour_interval, 'Heures|{'|'.join(TECHNOLOGIES)}' AS header FROM {COUNTS_SQL}")
def report_blocks(spark, folder):
    blocks = assign_blocks(stage(report_lines(spark, folder), "report"))
    return blocks.select(
        "day",
        (F.col("line") % 26).cast("int").alias("line_in_day"),
        F.get("cells", F.lit(0)).alias("hour_interval"),
        F.array_join("header", "|").alias("header"),
    )


@query("report_rows_long", f"SELECT day + to_hours(hour) AS datetime, day AS date, hour_interval, technology, CAST(value_mw AS DOUBLE) AS value_mw FROM {LONG_SQL}")
def report_rows_long(spark, folder):
    rows = rows_to_long(keep_hour_rows(assign_blocks(stage(report_lines(spark, folder), "report"))))
    return rows.select("datetime", "date", "hour_interval", "technology", "value_mw")


@query(
    "report_to_long_utc",
    f"""SELECT datetime, {paris_to_utc('day')} AS date, 2024 AS year, hour_interval, technology, CAST(value_mw AS DOUBLE) AS value_mw
        FROM (SELECT *, {paris_to_utc('t')} AS datetime FROM (SELECT *, day + to_hours(hour) AS t FROM {LONG_SQL}))
        WHERE datetime IS NOT NULL""",
)
def report_to_long_utc(spark, folder):
    return report_to_long(stage(report_lines(spark, folder), "report"), 2024)


@query(
    "report_to_long_local",
    f"""SELECT day + to_hours(hour) AS datetime, day AS date, 2024 AS year, hour_interval, technology, CAST(value_mw AS DOUBLE) AS value_mw FROM {LONG_SQL}""",
)
def report_to_long_local(spark, folder):
    return report_to_long(stage(report_lines(spark, folder), "report"), 2024, tz="local")
