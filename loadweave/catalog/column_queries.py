"""Projections, filters, scalar functions, calendar features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loadweave.catalog.registry import READINGS, paris_to_utc, query, readings, rounded, table
from loadweave.functions import schema as S
from loadweave.functions import text as X
from loadweave.functions import timeutil as T
from loadweave.functions.calendar import calendar_columns, cyclic_columns, holiday_table, with_holiday_flag
from loadweave.operators.report import keep_hour_rows


@query("header_normalise", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def header_normalise(spark, folder):
    raw = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").toDF(" C_CustKey ", "C_NAME", "c_acctbal  ")
    return S.normalise_names(raw)


@query("header_keep_first_duplicate", "SELECT ts AS datetime, value FROM events")
def header_keep_first_duplicate(spark, folder):
    e = table(spark, folder, "events")
    return S.first_of_each_name(e.select("ts", "value", "event_id").toDF("datetime", "value", "datetime"))


@query(
    "header_unique_labels",
    """SELECT event_id, CASE WHEN event_type = 'view'
         THEN 'view|Unnamed|view__2|Unnamed__2|view__3'
         ELSE event_type || '|Unnamed|' || event_type || '__2|Unnamed__2|view' END AS labels FROM events""",
)
def header_unique_labels(spark, folder):
    labels = F.array(F.col("event_type"), F.lit(""), F.concat(F.lit(" "), "event_type"), F.lit("nan"), F.lit("view"))
    return table(spark, folder, "events").select("event_id", F.array_join(X.unique_labels(labels), "|").alias("labels"))


@query("load_column_alias", "SELECT ts AS datetime, value AS load_mw FROM events")
def load_column_alias(spark, folder):
    e = table(spark, folder, "events")
    return S.alias_load(e.select(F.col("ts").alias("datetime"), F.col("value").cast("string").alias("conso_mw")))


@query("load_column_first_numeric", "SELECT ts AS datetime, event_type AS label, value AS load_mw FROM events")
def load_column_first_numeric(spark, folder):
    e = table(spark, folder, "events")
    raw = e.select(F.col("ts").alias("datetime"), F.col("event_type").alias("label"), F.col("value").cast("string").alias("reading"))
    return S.alias_load(raw)


@query("required_columns", "SELECT city, datetime FROM " + READINGS)
def required_columns(spark, folder):
    return S.require_columns(readings(spark, folder).select("city", "datetime"), "city", ("datetime", "date"))


_DAY_TEXT = "lpad(CAST(l_orderkey % 40 AS VARCHAR), 2, '0') || '/' || lpad(CAST(l_linenumber + 1 AS VARCHAR), 2, '0') || '/' || CAST(1996 + l_suppkey % 9 AS VARCHAR)"


@query("timestamp_parse", f"SELECT l_orderkey, l_linenumber, l_suppkey, try_strptime({_DAY_TEXT}, '%d/%m/%Y') AS day FROM lineitem")
def timestamp_parse(spark, folder):
    text = F.concat_ws(
        "/",
        F.lpad((F.col("l_orderkey") % 40).cast("string"), 2, "0"),
        F.lpad((F.col("l_linenumber") + 1).cast("string"), 2, "0"),
        (F.lit(1996) + F.col("l_suppkey") % 9).cast("string"),
    )
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", T.parse_day(text).alias("day"))


@query(
    "timestamp_formats",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN date_trunc('minute', ts) WHEN 'view' THEN date_trunc('second', ts) ELSE ts END AS datetime
       FROM events""",
)
def timestamp_formats(spark, folder):
    """Times as ISO text, in two other formats, and as text that is no time."""
    kind = F.col("event_type")
    text = F.when(kind == "error", "n.c.").when(kind == "click", F.date_format("ts", "yyyy/M/d H:mm")).when(kind == "view", F.date_format("ts", "d.M.yyyy HH:mm:ss"))
    text = text.otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return table(spark, folder, "events").select("event_id", T.utc_from_text(text, ["yyyy/M/d H:mm", "d.M.yyyy HH:mm:ss"]).alias("datetime"))


@query(
    "drop_null_keys",
    """SELECT event_id, city, datetime FROM (
         SELECT event_id, CASE WHEN city <> 3 THEN city END AS city,
                CASE WHEN technology <> 'error' THEN datetime END AS datetime FROM """
    + READINGS
    + ") WHERE city IS NOT NULL AND datetime IS NOT NULL",
)
def drop_null_keys(spark, folder):
    r = readings(spark, folder)
    holes = r.select(
        "event_id",
        F.when(F.col("city") != 3, F.col("city")).alias("city"),
        F.when(F.col("technology") != "error", F.col("datetime")).alias("datetime"),
    )
    return S.drop_null_keys(holes, "city", "datetime")


_SHIFTED = "(SELECT event_id, ts + INTERVAL 70 DAY AS t FROM events UNION ALL SELECT event_id, ts + INTERVAL 290 DAY FROM events)"


@query("utc_from_local", f"SELECT event_id, t AS local_time, {paris_to_utc('t')} AS datetime FROM {_SHIFTED}")
def utc_from_local(spark, folder):
    e = table(spark, folder, "events")
    shifts = F.explode(F.array(F.lit(70), F.lit(290)))
    shifted = e.select("event_id", "ts", shifts.alias("days")).select("event_id", (F.col("ts") + T.interval(days=F.col("days"))).alias("local_time"))
    return shifted.withColumn("datetime", T.utc_from_local("local_time"))


@query(
    "utc_from_offsets",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN ts - INTERVAL 1 HOUR WHEN 2 THEN ts - INTERVAL 2 HOUR
              ELSE ts END AS datetime FROM events""",
)
def utc_from_offsets(spark, folder):
    kind = F.col("event_id") % 4
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    offset = F.when(kind == 1, "+01:00").when(kind == 2, "+02:00").when(kind == 3, "Z").otherwise("")
    return table(spark, folder, "events").select("event_id", T.utc_from_iso(F.concat(stamp, offset)).alias("datetime"))


@query("naive_utc", "SELECT event_id, ts - INTERVAL 1 HOUR AS datetime FROM events")
def naive_utc(spark, folder):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+01:00"))
    aware = table(spark, folder, "events").select("event_id", stamp.cast("timestamp").alias("aware"))
    return aware.select("event_id", T.naive_utc("aware").alias("datetime"))


@query("trim_entity", "SELECT c_custkey, c_mktsegment AS city FROM customer")
def trim_entity(spark, folder):
    padded = F.concat(F.lit(" \t"), "c_mktsegment", F.lit("  "))
    return table(spark, folder, "customer").select("c_custkey", X.strip(padded).alias("city"))


@query("drop_columns", "SELECT datetime, load_mw FROM " + READINGS)
def drop_columns(spark, folder):
    r = readings(spark, folder).withColumnsRenamed({"technology": "statut", "event_id": "slot_index"})
    return S.drop_if_present(r, "statut", "slot_index", "date", "city").select("datetime", "load_mw")


@query("drop_empty_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def drop_empty_columns(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderstatus", "o_orderstatus").alias("empty"), "o_totalprice")
    return S.drop_empty_columns(o)


@query("optional_column", "SELECT o_orderkey, o_orderstatus AS statut, CAST(NULL AS VARCHAR) AS remark FROM orders")
def optional_column(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return S.optional_column(S.optional_column(o, "statut", source="o_orderstatus"), "remark").drop("o_orderstatus")


@query(
    "slot_timestamp",
    """SELECT l_orderkey, l_linenumber, l_shipdate + to_minutes(CAST(l_partkey % 48 AS INTEGER) * 30) AS datetime FROM lineitem""",
)
def slot_timestamp(spark, folder):
    day = F.col("l_shipdate").cast("date")
    slot = T.slot_timestamp(day, F.col("l_partkey") % 48)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", slot.alias("datetime"))


@query(
    "date_line",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate END AS day, o_orderkey % 3 < 2 AS is_date
       FROM orders""",
)
def date_line(spark, folder):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    kind = F.col("o_orderkey") % 3
    line = F.when(kind == 0, F.concat(F.lit("DONNÉES de production du "), day)).when(kind == 1, F.concat(F.lit("Réalisation : "), day))
    text = line.otherwise(F.concat(F.lit("Total du "), day))
    return table(spark, folder, "orders").select(
        "o_orderkey", T.parse_day(X.date_text(text)).alias("day"), X.is_date_line(text).alias("is_date")
    )


_HOUR = "lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00'"


@query(
    "hour_interval",
    f"""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN {_HOUR} || chr(160) || '–' || chr(8239) || {_HOUR} ELSE {_HOUR} || ' – ' || {_HOUR} END AS hour_interval,
              CASE WHEN event_type = 'error' THEN NULL ELSE CAST(hour(ts) * 60 AS INTEGER) END AS start_minute FROM events""",
)
def hour_interval(spark, folder):
    hour = F.concat(F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit(":00"))
    label = F.concat(hour, F.when(F.col("event_type") == "click", "\u00a0–\u202f").otherwise(" – "), hour)
    cells = F.when(F.col("event_type") == "error", F.array(F.lit("Total"), F.lit("-")))
    cells = cells.when(F.col("event_type") == "view", F.array(F.lit("x"), label)).otherwise(F.array(label, F.lit("x")))
    found = table(spark, folder, "events").select("event_id", X.hour_interval(cells, 0).alias("hour_interval"))
    return found.withColumn("start_minute", X.interval_start_minutes("hour_interval"))


@query(
    "report_number",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN NULL WHEN 'view' THEN 0.0
              ELSE 1000 * (event_id % 7 + 1) + (event_id % 10) / 10.0 END AS value_mw FROM events""",
)
def report_number(spark, folder):
    whole = F.concat((F.col("event_id") % 7 + 1).cast("string"), F.lit(" 000,"), (F.col("event_id") % 10).cast("string"))
    kind = F.col("event_type")
    cell = F.when(kind == "click", "-").when(kind == "error", "n.c.").when(kind == "view", " ").otherwise(whole)
    return table(spark, folder, "events").select("event_id", X.report_number(cell).alias("value_mw"))


@query(
    "skip_rows_without_hour",
    f"SELECT event_id, {_HOUR} || '-' || {_HOUR} AS hour_interval FROM events WHERE event_type NOT IN ('error', 'view')",
)
def skip_rows_without_hour(spark, folder):
    hour = F.concat(F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit(":00"))
    label = F.when(F.col("event_type") == "error", "Total").when(F.col("event_type") == "view", "").otherwise(F.concat(hour, F.lit("-"), hour))
    blocks = table(spark, folder, "events").select("event_id", F.array(label, F.lit("12")).alias("cells"), F.lit(0).alias("hour_pos"))
    return keep_hour_rows(blocks).select("event_id", "hour_interval")


@query("type_membership", "SELECT event_id, technology, load_mw FROM " + READINGS + " WHERE technology IN ('view', 'click')")
def type_membership(spark, folder):
    return readings(spark, folder).where(F.col("technology").isin("view", "click")).select("event_id", "technology", "load_mw")


@query("year_selection", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999")
def year_selection(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return T.select_years(o, "1996-1999")


@query(
    "time_range_year_to_date",
    """SELECT event_id, ts AS datetime FROM events
       WHERE ts >= TIMESTAMP '2023-12-31 23:00:00' AND ts < TIMESTAMP '2024-01-20 13:00:00'""",
)
def time_range_year_to_date(spark, folder):
    r = readings(spark, folder).select("event_id", "datetime")
    return T.year_to_date(r, "datetime", "2024-01-20 12:00:00", ahead_hours=1)


@query(
    "time_range_last_days",
    """SELECT event_id, ts AS datetime FROM events
       WHERE ts >= TIMESTAMP '2024-01-12 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
)
def time_range_last_days(spark, folder):
    return T.last_days(readings(spark, folder).select("event_id", "datetime"), "datetime", "2024-01-20 12:00:00")


@query(
    "time_range_past_and_future",
    """SELECT event_id, ts AS datetime FROM events
       WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts < TIMESTAMP '2024-01-27 00:00:00'""",
)
def time_range_past_and_future(spark, folder):
    return T.past_and_future_days(readings(spark, folder).select("event_id", "datetime"), "datetime", "2024-01-20 12:00:00")


@query("constant_tag", "SELECT s_suppkey, 2024 AS year, 'national' AS city FROM supplier")
def constant_tag(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey")
    return S.tag(S.tag(s, "year", 2024), "city", "national")


_CALENDAR_SQL = """CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(month(ts) AS INTEGER) AS month,
  CAST(dayofyear(ts) AS INTEGER) AS dayofyear"""


@query("calendar_parts", f"SELECT event_id, {_CALENDAR_SQL} FROM events")
def calendar_parts(spark, folder):
    return table(spark, folder, "events").select("event_id", *[c.alias(n) for n, c in calendar_columns("ts").items()])


@query("day_of_week", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dayofweek FROM orders")
def day_of_week(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", calendar_columns("o_orderdate")["dayofweek"].alias("dayofweek"))


@query(
    "weekend_load",
    """SELECT CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, count(*) AS n, round(avg(value), 6) AS load_mw
       FROM events GROUP BY 1""",
)
def weekend_load(spark, folder):
    e = table(spark, folder, "events")
    grouped = e.groupBy(calendar_columns("ts")["is_weekend"].alias("is_weekend"))
    return rounded(grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("load_mw")), "load_mw")


@query(
    "cyclic_hour",
    f"""SELECT event_id, round(sin(2 * {math.pi!r} * hour(ts) / 24.0), 6) AS hour_sin,
              round(cos(2 * {math.pi!r} * hour(ts) / 24.0), 6) AS hour_cos FROM events""",
)
def cyclic_hour(spark, folder):
    c = cyclic_columns("ts")
    return table(spark, folder, "events").select("event_id", *[F.round(c[n], 6).alias(n) for n in ("hour_sin", "hour_cos")])


@query(
    "cyclic_day_of_year",
    f"""SELECT o_orderkey, round(sin(2 * {math.pi!r} * dayofyear(o_orderdate) / 366.0), 6) AS doy_sin,
              round(cos(2 * {math.pi!r} * dayofyear(o_orderdate) / 366.0), 6) AS doy_cos FROM orders""",
)
def cyclic_day_of_year(spark, folder):
    c = cyclic_columns("o_orderdate")
    return table(spark, folder, "orders").select("o_orderkey", *[F.round(c[n], 6).alias(n) for n in ("doy_sin", "doy_cos")])


_HOLIDAY_SQL = """
WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem),
a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y),
h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h),
m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l),
e AS (SELECT y, make_date(CAST(y AS BIGINT), (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM m),
d AS (SELECT easter + 1 AS day FROM e UNION SELECT easter + 39 FROM e UNION SELECT easter + 50 FROM e
      UNION SELECT make_date(CAST(y AS BIGINT), f.mm, f.dd) FROM e,
        (VALUES (1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)) AS f(mm, dd))
SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN d.day IS NULL THEN 0 ELSE 1 END AS is_holiday
FROM lineitem LEFT JOIN d ON CAST(l_shipdate AS DATE) = d.day
"""


@query("holiday_flag", _HOLIDAY_SQL)
def holiday_flag(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    span = items.agg(F.year(F.min("l_shipdate")), F.year(F.max("l_shipdate"))).first()
    return with_holiday_flag(items, "l_shipdate", holiday_table(spark, span[0], span[1])).drop("l_shipdate")
