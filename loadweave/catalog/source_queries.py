"""Sources and sinks: the given tables written in each raw form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.registry import READINGS, TECHNOLOGIES, VARIABLES, WEATHER_ROWS, paris_to_utc, query, readings, rounded, table, weather_rows
from loadweave.catalog.reshape_queries import COUNTS_SQL, HOURS, LONG_SQL, report_rows, wide_days
from loadweave.functions.timeutil import hour_floor, step_floor
from loadweave.plans.datasets import build_hourly_dataset, build_load_dataset, build_weather_dataset, normalise_load_years, normalise_reports
from loadweave.session import scratch_path
from loadweave.sources import files, payloads, tables
from loadweave.sources.report_text import read_report_lines

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("load_csv_scan", "SELECT ts AS datetime, value AS load_mw FROM events")
def load_csv_scan(spark, folder):
    """Long load files of two generations, with different names for the same columns."""
    root = scratch_path(spark, "load-csv")
    e = table(spark, folder, "events").withColumn("stamp", F.date_format("ts", _STAMP))
    recent = e.where("event_type = 'view'").select(F.col("stamp").alias("datetime"), F.lit("D").alias("statut"), F.col("value").alias("valeur"))
    older = e.where("event_type <> 'view'").select(F.col("stamp").alias(" DATETIME"), F.col("value").alias("CONSO_MW "))
    recent.write.option("header", True).csv(f"{root}/recent")
    older.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/older")
    return files.read_load_long(spark, [f"{root}/recent", f"{root}/older"]).select("datetime", "load_mw")


@query(
    "weather_csv_union",
    f"""SELECT datetime, 'city ' || city AS city, temperature_2m,
               CASE WHEN city % 2 = 0 THEN wind_speed_10m END AS wind_speed_10m FROM (
          SELECT datetime, city, temperature_2m, round(wind_speed_10m, 6) AS wind_speed_10m FROM {WEATHER_ROWS})""",
)
def weather_csv_union(spark, folder):
    root = scratch_path(spark, "weather-csv")
    w = rounded(weather_rows(spark, folder), "wind_speed_10m")
    city = F.concat(F.lit("city "), F.col("city").cast("string")).alias("city")
    stamp = F.date_format("datetime", _STAMP + "'+00:00'").alias("date")
    w.where("city % 2 = 0").select(stamp, "temperature_2m", "wind_speed_10m", city).write.option("header", True).csv(f"{root}/full")
    w.where("city % 2 = 1").select(city, stamp, "temperature_2m").write.option("header", True).csv(f"{root}/short")
    read = files.read_weather(spark, [f"{root}/full", f"{root}/short"])
    return read.select("datetime", "city", "temperature_2m", "wind_speed_10m")


@query(
    "load_wide_scan",
    "SELECT strftime(CAST(ts AS DATE), '%d/%m/%Y') AS day, "
    + ", ".join(f"round(avg(CASE WHEN hour(ts) = {h} THEN value END), 6) AS h{h:02d}" for h in HOURS)
    + " FROM events GROUP BY 1",
)
def load_wide_scan(spark, folder):
    root = scratch_path(spark, "load-wide")
    hours = [f"h{h:02d}" for h in HOURS]
    wide = rounded(wide_days(spark, folder, shift=0), *hours)
    name = files.WIDE_STEM.format(year=2024)
    wide.write.option("header", True).option("sep", ";").csv(f"{root}/2024/{name}.csv")
    wide.select("day").write.parquet(f"{root}/2024/another.parquet")
    read = files.read_load_wide(spark, root, "2023-2024")[2024]
    return read.select("day", *[F.col(h).cast("double").alias(h) for h in hours])


@query(
    "report_text_scan",
    f"""SELECT 'Données de réalisation du ' || strftime(day, '%d/%m/%Y') || '{'|' * len(TECHNOLOGIES)}' AS cells FROM {COUNTS_SQL} GROUP BY day
        UNION ALL SELECT 'Heures|{"|".join(TECHNOLOGIES)}' FROM {COUNTS_SQL} GROUP BY day
        UNION ALL SELECT lpad(CAST(hour AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(hour + 1 AS VARCHAR), 2, '0') || ':00|' ||
          {" || '|' || ".join(f"CASE WHEN {k} = 0 THEN '-' ELSE CAST({k} AS VARCHAR) || ',5' END" for k in TECHNOLOGIES)} FROM {COUNTS_SQL}""",
)
def report_text_scan(spark, folder):
    path = scratch_path(spark, "report-text")
    ordered = report_rows(spark, folder).repartitionByRange("day").sortWithinPartitions("day", "number")
    ordered.select("text").write.text(path)
    return read_report_lines(spark, path).select(F.array_join("cells", "|").alias("cells"))


def _offset_time(t: str):
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+01:00"))


_OFFSET_SQL = "strftime({t}, '%Y-%m-%dT%H:%M:%S.%f') || '+01:00'"
PAGE = 200  # values per payload


def _value_struct(extra=()):
    return F.struct(
        *extra,
        _offset_time("ts").alias("start_date"),
        F.lit("2024-12-31T00:00:00+01:00").alias("end_date"),
        _offset_time("ts").alias("updated_date"),
        F.col("value"),
    )


def load_payloads(spark, folder):
    """Events as load payloads: pages of values in a measured and a forecast block."""
    e = table(spark, folder, "events")
    page = F.floor(F.col("event_id") / PAGE).alias("page")
    kind = F.when(F.col("event_type") == "error", "ID").otherwise("REALISED").alias("type")
    blocks = e.groupBy(page, kind).agg(F.collect_list(_value_struct()).alias("values"))
    pages = blocks.groupBy("page").agg(F.collect_list(F.struct("type", "values")).alias("short_term"))
    return pages.select("page", F.to_json(F.struct("short_term")).alias("json"))


@query(
    "load_payload_flatten",
    f"""SELECT {_OFFSET_SQL.format(t='ts')} AS start_date, '2024-12-31T00:00:00+01:00' AS end_date,
               {_OFFSET_SQL.format(t='ts')} AS updated_date, value AS consumption_mw FROM events WHERE event_type <> 'error'""",
)
def load_payload_flatten(spark, folder):
    parsed = load_payloads(spark, folder).select(F.from_json("json", payloads.LOAD_PAYLOAD).alias("p")).select("p.*")
    return payloads.flatten_load(parsed)


@query(
    "load_payload_table",
    """SELECT ts - INTERVAL 1 HOUR AS start_date, TIMESTAMP '2024-12-30 23:00:00' AS end_date, ts - INTERVAL 1 HOUR AS updated_date,
              value AS consumption_mw FROM events WHERE event_type <> 'error'""",
)
def load_payload_table(spark, folder):
    parsed = load_payloads(spark, folder).select(F.from_json("json", payloads.LOAD_PAYLOAD).alias("p")).select("p.*")
    return payloads.load_table(parsed)


_PAGE_FAULT = f"""(CASE event_id // {PAGE} % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'no object' WHEN 3 THEN 'shape' END)"""


def damaged_payloads(spark, folder):
    """Load payloads of which two pages in five are whole."""
    json, kind = F.col("json"), F.col("page") % 5
    text = F.when(kind == 1, F.substring(json, F.lit(1), F.length(json) - 5)).when(kind == 2, F.concat(F.lit("["), json, F.lit("]")))
    return load_payloads(spark, folder).select("page", text.when(kind == 3, '{"short_term": "none"}').otherwise(json).alias("json"))


@query(
    "load_payload_damaged",
    f"""SELECT {_OFFSET_SQL.format(t='ts')} AS start_date, '2024-12-31T00:00:00+01:00' AS end_date,
               {_OFFSET_SQL.format(t='ts')} AS updated_date, value AS consumption_mw FROM events WHERE event_type <> 'error' AND {_PAGE_FAULT} IS NULL""",
)
def load_payload_damaged(spark, folder):
    good, _ = payloads.parse_payloads(damaged_payloads(spark, folder), "json", payloads.LOAD_PAYLOAD)
    return payloads.flatten_load(good)


@query("load_payload_rejects", f"SELECT DISTINCT CAST(event_id // {PAGE} AS BIGINT) AS page, {_PAGE_FAULT} AS fault FROM events WHERE {_PAGE_FAULT} IS NOT NULL")
def load_payload_rejects(spark, folder):
    _, rejected = payloads.parse_payloads(damaged_payloads(spark, folder), "json", payloads.LOAD_PAYLOAD)
    return rejected.select("page", "fault")


@query(
    "mix_payload_flatten",
    f"""SELECT event_type AS production_type, CASE WHEN user_id % 3 > 0 THEN 'SUB_' || user_id % 3 END AS production_subtype,
               {_OFFSET_SQL.format(t='ts')} AS start_date, '2024-12-31T00:00:00+01:00' AS end_date,
               {_OFFSET_SQL.format(t='ts')} AS updated_date, value AS value_mw FROM events""",
)
def mix_payload_flatten(spark, folder):
    e = table(spark, folder, "events")
    sub = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("SUB_"), (F.col("user_id") % 3).cast("string")))
    page = F.floor(F.col("event_id") / PAGE).alias("page")
    blocks = e.groupBy(page, F.col("event_type").alias("production_type"), sub.alias("production_subtype")).agg(
        F.collect_list(_value_struct()).alias("values")
    )
    block = F.struct("production_type", "production_subtype", "values")
    pages = blocks.groupBy("page").agg(F.collect_list(block).alias("generation_mix_15min_time_scale"))
    text = pages.select(F.to_json(F.struct("generation_mix_15min_time_scale")).alias("json"))
    return payloads.flatten_mix(text.select(F.from_json("json", payloads.MIX_PAYLOAD).alias("p")).select("p.*"))


@query(
    "capacity_payload_flatten",
    f"""SELECT event_type AS production_type, {_OFFSET_SQL.format(t='ts')} AS start_date, '2024-12-31T00:00:00+01:00' AS end_date,
               {_OFFSET_SQL.format(t='ts')} AS updated_date, value AS installed_capacity_mw FROM events""",
)
def capacity_payload_flatten(spark, folder):
    e = table(spark, folder, "events")
    page = F.floor(F.col("event_id") / PAGE).alias("page")
    values = F.collect_list(_value_struct([F.col("event_type").alias("type")])).alias("values")
    bounds = [F.lit("2024-01-01").alias("start_date"), F.lit("2025-01-01").alias("end_date")]
    blocks = e.groupBy(page).agg(values).select(F.array(F.struct(*bounds, "values")).alias("capacities_per_production_type"))
    text = blocks.select(F.to_json(F.struct("capacities_per_production_type")).alias("json"))
    return payloads.flatten_capacity(text.select(F.from_json("json", payloads.CAPACITY_PAYLOAD).alias("p")).select("p.*"))


@query(
    "weather_payload_expand",
    f"""WITH d AS (SELECT city, CAST(datetime AS DATE) + INTERVAL 0 DAY AS day FROM {WEATHER_ROWS} GROUP BY 1, 2),
        h AS (SELECT city, date_trunc('hour', datetime) AS datetime, {", ".join(f"round(avg({v}), 6) AS {v}" for v in VARIABLES)}
              FROM {WEATHER_ROWS} GROUP BY 1, 2)
        SELECT 'c' || d.city AS city, d.day + to_hours(CAST(s.k AS INTEGER)) AS datetime, {", ".join(f"h.{v} AS {v}" for v in VARIABLES)}
        FROM d CROSS JOIN (SELECT unnest(range(24)) AS k) s
        LEFT JOIN h ON h.city = d.city AND h.datetime = d.day + to_hours(CAST(s.k AS INTEGER))""",
)
def weather_payload_expand(spark, folder):
    """One payload per city and day with 24 hourly values per variable."""
    w = weather_rows(spark, folder)
    hour = F.hour("datetime")
    cells = [F.round(F.avg(F.when(hour == h, F.col(v))), 6).alias(f"{v}_{h}") for v in VARIABLES for h in HOURS]
    days = w.groupBy("city", F.col("datetime").cast("date").alias("day")).agg(*cells)
    start = F.unix_date("day").cast("long") * 86400
    arrays = [F.array(*[F.col(f"{v}_{h}") for h in HOURS]).alias(v) for v in VARIABLES]
    payload = days.select(
        F.concat(F.lit("c"), F.col("city").cast("string")).alias("city"),
        start.alias("time"), (start + 86400).alias("time_end"), F.lit(3600).alias("interval"), *arrays,
    )
    return payloads.expand_hourly(payload)


@query(
    "city_reference",
    """SELECT 'Nation ' || c_nationkey AS city, count(*) AS population, count(*) / 1000.0 AS weight,
              CAST(c_nationkey AS DOUBLE) + 0.5 AS latitude, CAST(-c_nationkey AS DOUBLE) AS longitude FROM customer GROUP BY c_nationkey""",
)
def city_reference(spark, folder):
    path = scratch_path(spark, "cities")
    n = F.count(F.lit(1))
    weight = F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"))
    table(spark, folder, "customer").groupBy("c_nationkey").agg(n.alias("Population"), weight.alias("Formule")).select(
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("Agglomération"),
        "Population",
        "Formule",
        (F.col("c_nationkey") + 0.5).cast("double").alias("Latitude"),
        (-F.col("c_nationkey")).cast("double").alias("Longitude"),
    ).write.option("header", True).csv(path)
    return files.read_cities(spark, path)


@query(
    "capacity_year_scan",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS production_type, CAST(count(*) + 0.5 AS DOUBLE) AS installed_capacity_mw
       FROM orders GROUP BY 1, 2""",
)
def capacity_year_scan(spark, folder):
    """One text file per year: title, blank line, header, rows, blank line, footer."""
    path = scratch_path(spark, "capacity")
    o = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    rows = o.groupBy("year", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    lines = rows.select("year", F.lit(3).alias("k"), F.concat_ws(";", "o_orderpriority", F.concat(F.col("n").cast("string"), F.lit(".5"))).alias("line"))
    frame = ((0, F.lit("\ufeffCapacité installée par filière.")), (1, F.lit("")), (2, F.concat(F.lit("Type;"), F.col("year").cast("string"))), (4, F.lit("")), (5, F.lit("Mentions légales, sans garantie.")))
    around = rows.select("year").distinct().select("year", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), text.alias("line")) for k, text in frame])).alias("f"))
    ordered = lines.unionByName(around.select("year", "f.k", "f.line")).repartitionByRange("year").sortWithinPartitions("year", "k")
    ordered.select("year", "line").write.partitionBy("year").text(path)
    return files.read_capacity_year(spark, path)


@query("table_scan", "SELECT ts, value FROM events")
def table_scan(spark, folder):
    return tables.read_table(spark, f"{folder}/events.parquet", ["ts", "value"])


@query("parquet_sink", "SELECT datetime, load_mw FROM " + READINGS)
def parquet_sink(spark, folder):
    path = scratch_path(spark, "sink")
    tables.write_parquet(readings(spark, folder).select("datetime", "load_mw"), f"{path}/clean/load", sort="datetime")
    return spark.read.parquet(f"{path}/clean/load")


@query(
    "csv_year_sink",
    "SELECT o_orderkey, o_orderdate AS datetime, o_totalprice AS load_mw, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) IN (1996, 1999)",
)
def csv_year_sink(spark, folder):
    path = scratch_path(spark, "years")
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("datetime"), F.col("o_totalprice").alias("load_mw"), F.year("o_orderdate").alias("year"))
    tables.write_years(o, path)
    return tables.read_years(spark, path, "o_orderkey long, datetime timestamp_ntz, load_mw double, year int", [1996, 1999])


@query("history_scan", "SELECT datetime, load_mw FROM " + READINGS + " ORDER BY datetime")
def history_scan(spark, folder):
    path = scratch_path(spark, "history")
    tables.write_parquet(readings(spark, folder).select("datetime", "load_mw"), path)
    return tables.read_history(spark, path)


@query("load_files_to_dataset", "SELECT date_trunc('hour', ts) AS datetime, round(avg(value), 6) AS load_mw FROM events GROUP BY 1")
def load_files_to_dataset(spark, folder):
    """CSV files in which every hour occurs twice, through the complete cleaning job."""
    root = scratch_path(spark, "load-job")
    r = readings(spark, folder)
    hours = r.groupBy(hour_floor("datetime").alias("datetime")).agg(F.round(F.avg("load_mw"), 6).alias("load_mw"))
    rows = hours.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "load_mw")
    rows.union(rows).write.option("header", True).csv(f"{root}/raw")
    dataset, _ = build_load_dataset(spark, f"{root}/raw", f"{root}/clean")
    return dataset


_REJECTED = """
  (SELECT technology AS kind, b, CASE WHEN hour(b) % 7 = 3 THEN NULL ELSE b END AS t, hour(b) % 11 = 5 AS no_number, unnest(range(CASE WHEN hour(b) % 5 = 0 THEN 2 ELSE 1 END)) AS copy
   FROM (SELECT event_type AS technology, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events GROUP BY 1, 2))
"""


@query(
    "load_rejected_rows",
    f"""WITH r AS (SELECT * FROM {_REJECTED}), u AS (SELECT DISTINCT kind, t FROM r WHERE t IS NOT NULL),
          s AS (SELECT kind, t, t - lag(t) OVER (PARTITION BY kind ORDER BY t) AS step FROM u),
          c AS (SELECT kind, count(*) AS "rows", min(t) AS min_dt, max(t) AS max_dt, count(*) FILTER (WHERE step <> INTERVAL 30 MINUTE) AS n_bad_steps FROM s GROUP BY 1)
        SELECT r.kind, c."rows", c.min_dt, c.max_dt, c.n_bad_steps, count(*) AS rows_read, count(*) FILTER (WHERE t IS NULL) AS no_time,
          count(*) FILTER (WHERE t IS NOT NULL AND no_number) AS no_number, count(*) FILTER (WHERE t IS NOT NULL) - c."rows" AS duplicates
        FROM r JOIN c ON c.kind = r.kind GROUP BY r.kind, c."rows", c.min_dt, c.max_dt, c.n_bad_steps""",
)
def load_rejected_rows(spark, folder):
    """Files of one name in a folder per technology, each with a blank first line, bad times, bad numbers and repeats: one report line per path."""
    root = scratch_path(spark, "load-rejected")
    r = readings(spark, folder)
    halves = r.groupBy(F.col("technology").alias("kind"), step_floor("datetime", 30).alias("b")).agg(F.round(F.avg("load_mw"), 6).alias("v"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.hour("b") % 5 == 0, 2).otherwise(1))).alias("copy")
    stamp = F.when(F.hour("b") % 7 == 3, "bad").otherwise(F.date_format("b", "yyyy-MM-dd HH:mm:ss"))
    rows = halves.select("kind", F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("place"), copies, F.concat_ws(",", stamp, F.when(F.hour("b") % 11 == 5, "n/a").otherwise(F.col("v").cast("string"))).alias("value"))
    heads = halves.select("kind").distinct().select("kind", F.explode(F.array(*[F.struct(F.lit(place).alias("place"), F.lit(0).alias("copy"), F.lit(text).alias("value")) for place, text in (("", ""), ("0", "datetime,load_mw"))])).alias("h"))
    # One writing task gives the file of every folder the same name; these are half hours, not events.
    ordered = heads.select("kind", "h.*").unionByName(rows).repartition(1).sortWithinPartitions("kind", "place", "copy")
    ordered.select("kind", "value").write.partitionBy("kind").text(f"{root}/raw")
    _, report = build_load_dataset(spark, f"{root}/raw/kind=*", f"{root}/clean")
    kind = F.regexp_extract("path", r"/kind=([^/]+)/[^/]*$", 1).alias("kind")
    return report.select(kind, "rows", "min_dt", "max_dt", "n_bad_steps", "rows_read", "no_time", "no_number", "duplicates")


@query(
    "hourly_job",
    f"""SELECT l.datetime, l.load_mw, w.temperature_2m FROM
          (SELECT date_trunc('hour', ts) AS datetime, round(avg(value), 6) AS load_mw FROM events GROUP BY 1) l
        JOIN (SELECT datetime, round(avg(t), 6) AS temperature_2m FROM (
            SELECT date_trunc('hour', datetime) AS datetime, city, avg(temperature_2m) AS t FROM {WEATHER_ROWS} GROUP BY 1, 2) GROUP BY 1) w
          ON l.datetime = w.datetime""",
)
def hourly_job(spark, folder):
    """CSV load and CSV city weather through all three jobs to the modeling table."""
    root = scratch_path(spark, "hourly-job")
    stamp = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime")
    load = readings(spark, folder).groupBy(hour_floor("datetime").alias("datetime")).agg(F.round(F.avg("load_mw"), 6).alias("load_mw"))
    load.select(stamp, "load_mw").write.option("header", True).csv(f"{root}/load")
    w = weather_rows(spark, folder).groupBy(hour_floor("datetime").alias("datetime"), F.col("city").cast("string").alias("city"))
    w.agg(F.avg("temperature_2m").alias("temperature_2m")).select(stamp, "city", "temperature_2m").write.option("header", True).csv(f"{root}/weather")
    build_load_dataset(spark, f"{root}/load", f"{root}/clean-load")
    build_weather_dataset(spark, f"{root}/weather", f"{root}/clean-weather")
    return rounded(build_hourly_dataset(spark, f"{root}/clean-load", f"{root}/clean-weather", f"{root}/hourly"), "temperature_2m")


@query(
    "wide_years_job",
    """SELECT day + to_hours(CAST(hour AS INTEGER)) AS datetime, day AS date, year, 'D' AS statut, CAST(hour AS INTEGER) AS slot_index, round(v, 6) AS load_mw
       FROM (SELECT CAST(2025 - y AS INTEGER) AS year, y, day, unnest(range(CASE WHEN y % 2 = 1 THEN 24 ELSE 12 END)) AS hour
             FROM (SELECT DISTINCT y, CAST(ts AS DATE) - to_years(y - 1) + INTERVAL 0 DAY AS day FROM events CROSS JOIN (SELECT unnest([1, 2, 3]) AS y)))
       LEFT JOIN (SELECT y AS vy, CAST(ts AS DATE) - to_years(y - 1) + INTERVAL 0 DAY AS vday, hour(ts) AS vhour, round(avg(value), 6) AS v
                  FROM events CROSS JOIN (SELECT unnest([1, 2, 3]) AS y) GROUP BY 1, 2, 3) ON vy = y AND vday = day AND vhour = hour""",
)
def wide_years_job(spark, folder):
    """Three yearly CSV files, the middle one with half the columns, through the whole job, local times kept."""
    root = scratch_path(spark, "wide-years")
    hours = [f"h{h:02d}" for h in HOURS]
    days = rounded(wide_days(spark, folder, shift=0), *hours)
    for back, width in enumerate((24, 12, 24)):
        year = 2024 - back
        moved = days.select(F.concat(F.substring("day", 1, 6), F.lit(str(year))).alias("day"), "status", *hours[:width])
        moved.write.option("header", True).option("sep", ";").csv(f"{root}/raw/{year}/load.csv")
    normalise_load_years(spark, f"{root}/raw", "2022-2024", f"{root}/long", step_minutes=60, tz="local")
    schema = "datetime timestamp_ntz, date timestamp_ntz, statut string, slot_index int, load_mw double, year int"
    return tables.read_years(spark, f"{root}/long", schema)


@query(
    "report_job",
    f"""SELECT datetime, {paris_to_utc('day')} AS date, 2024 AS year, hour_interval, technology, CAST(value_mw AS DOUBLE) AS value_mw
        FROM (SELECT *, {paris_to_utc('t')} AS datetime FROM (SELECT *, day + to_hours(hour) AS t FROM {LONG_SQL}))
        WHERE datetime IS NOT NULL""",
)
def report_job(spark, folder):
    """Report text files through decoding, blocks and UTC to CSV by year, read back."""
    path = scratch_path(spark, "report-job")
    ordered = report_rows(spark, folder).repartitionByRange("day").sortWithinPartitions("day", "number")
    ordered.select("text").write.text(f"{path}/raw")
    normalise_reports(spark, f"{path}/raw", f"{path}/long", year=2024)
    schema = "datetime timestamp_ntz, date timestamp_ntz, hour_interval string, technology string, value_mw double, year int"
    return tables.read_years(spark, f"{path}/long", schema)
