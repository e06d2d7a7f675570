"""Deduplication, windows and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.registry import READINGS, microseconds, query, readings, rounded, table
from loadweave.functions.timeutil import hour_floor, interval, step_floor
from loadweave.operators.dedup import keep_first, keep_last, mean_per_key
from loadweave.operators.quality import coverage, load_continuity, weather_continuity
from loadweave.operators.reshape import CELLS, number_slots, slot_cells
from loadweave.operators.windows import history_features, step_to_previous
from loadweave.session import stage


@query(
    "load_first_per_file",
    """SELECT technology AS file, date_trunc('hour', datetime) AS datetime, arg_min(load_mw, event_id) AS load_mw
       FROM """ + READINGS + " GROUP BY 1, 2",
)
def load_first_per_file(spark, folder):
    r = readings(spark, folder).select(F.col("technology").alias("file"), hour_floor("datetime").alias("datetime"), "load_mw", "event_id")
    return keep_first(r, ["file", "datetime"], ["event_id"]).drop("event_id")


@query(
    "load_first_across_files",
    """SELECT datetime, load_mw FROM (SELECT date_trunc('hour', datetime) AS datetime, load_mw,
         row_number() OVER (PARTITION BY date_trunc('hour', datetime) ORDER BY technology, event_id) AS rn FROM """
    + READINGS + ") WHERE rn = 1",
)
def load_first_across_files(spark, folder):
    r = readings(spark, folder).select(F.col("technology").alias("file"), hour_floor("datetime").alias("datetime"), "load_mw", "event_id")
    return keep_first(r, ["datetime"], ["file", "event_id"]).select("datetime", "load_mw")


@query(
    "weather_first_per_city",
    """SELECT city, date_trunc('hour', datetime) AS datetime, arg_min(load_mw, event_id) AS temperature_2m
       FROM """ + READINGS + " GROUP BY 1, 2",
)
def weather_first_per_city(spark, folder):
    r = readings(spark, folder).select("city", hour_floor("datetime").alias("datetime"), F.col("load_mw").alias("temperature_2m"), "event_id")
    return keep_first(r, ["city", "datetime"], ["event_id"]).drop("event_id")


@query(
    "load_last_per_interval",
    """SELECT date_trunc('hour', datetime) AS start_date, date_trunc('hour', datetime) + INTERVAL 1 HOUR AS end_date,
              arg_max(load_mw, event_id) AS consumption_mw FROM """ + READINGS + " GROUP BY 1, 2",
)
def load_last_per_interval(spark, folder):
    start = hour_floor("datetime")
    r = readings(spark, folder).select(start.alias("start_date"), (start + interval(hours=1)).alias("end_date"), F.col("load_mw").alias("consumption_mw"), "event_id")
    return keep_last(r, ["start_date", "end_date"], ["event_id"]).drop("event_id")


@query(
    "generation_last_per_key",
    """SELECT technology AS production_type, nullif(city % 3, 0) AS production_subtype, date_trunc('hour', datetime) AS start_date,
              arg_max(load_mw, event_id) AS value_mw FROM """ + READINGS + " GROUP BY 1, 2, 3",
)
def generation_last_per_key(spark, folder):
    r = readings(spark, folder).select(
        F.col("technology").alias("production_type"),
        F.nullif(F.col("city") % 3, F.lit(0)).alias("production_subtype"),
        hour_floor("datetime").alias("start_date"),
        F.col("load_mw").alias("value_mw"),
        "event_id",
    )
    return keep_last(r, ["production_type", "production_subtype", "start_date"], ["event_id"]).drop("event_id")


@query(
    "capacity_last_per_key",
    """SELECT o_orderpriority AS production_type, o_orderdate AS start_date, arg_max(o_totalprice, o_orderkey) AS installed_capacity_mw
       FROM orders GROUP BY 1, 2""",
)
def capacity_last_per_key(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("production_type"), F.col("o_orderdate").alias("start_date"),
        F.col("o_totalprice").alias("installed_capacity_mw"), "o_orderkey",
    )
    return keep_last(o, ["production_type", "start_date"], ["o_orderkey"]).drop("o_orderkey")


@query(
    "mean_of_duplicates",
    """SELECT date_trunc('hour', datetime) AS datetime, technology, nullif(city, 0) AS statut, round(avg(load_mw), 6) AS load_mw
       FROM """ + READINGS + " GROUP BY 1, 2, 3",
)
def mean_of_duplicates(spark, folder):
    r = readings(spark, folder).select(hour_floor("datetime").alias("datetime"), "technology", F.nullif("city", F.lit(0)).alias("statut"), "load_mw")
    return rounded(mean_per_key(r, ["datetime", "technology", "statut"], "load_mw"), "load_mw")


@query(
    "slot_index",
    """SELECT day AS date, statut, CAST(row_number() OVER (PARTITION BY day ORDER BY slot, rank) - 1 AS INTEGER) AS slot_index,
              round(v, 6) AS load_mw
       FROM (SELECT CAST(ts AS DATE) + INTERVAL 0 DAY AS day, event_type AS statut, dense_rank() OVER (ORDER BY event_type) AS rank,
                    unnest([2, 3, 10]) AS slot, unnest([count(*) + 0.0, sum(value), min(value)]) AS v
             FROM events GROUP BY 1, 2)""",
)
def slot_index(spark, folder):
    e = table(spark, folder, "events")
    # Several wide rows per date: one per event type, ranked by its name.
    days = e.groupBy(F.col("ts").cast("date").cast("timestamp_ntz").alias("date"), F.col("event_type").alias("statut")).agg(
        F.ascii("statut").cast("long").alias("_row"),
        F.count(F.lit(1)).cast("double").alias("col_2"),
        F.sum("value").alias("col_3"),
        F.min("value").alias("col_10"),
    )
    long = number_slots(days.withColumns({"year": F.lit(2024), CELLS: slot_cells(days, ["col_2", "col_3", "col_10"])}))
    return rounded(long.select("date", "statut", "slot_index", "load_mw"), "load_mw")


@query(
    "step_national",
    "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS step_us FROM events",
)
def step_national(spark, folder):
    r = readings(spark, folder).select("event_id", "datetime")
    return step_to_previous(r, "datetime").select("event_id", microseconds(F.col("step")).alias("step_us"))


@query(
    "step_per_city",
    """SELECT event_id, city, epoch_us(datetime) - lag(epoch_us(datetime)) OVER (PARTITION BY city ORDER BY datetime) AS step_us
       FROM """ + READINGS,
)
def step_per_city(spark, folder):
    r = readings(spark, folder).select("event_id", "city", "datetime")
    return step_to_previous(r, "datetime", ["city"]).select("event_id", "city", microseconds(F.col("step")).alias("step_us"))


def _lag_sql(series: str) -> str:
    lags = {"load_lag_1h": 2, "load_lag_24h": 48, "load_lag_48h": 96, "load_lag_168h": 336}
    columns = ", ".join(f"lag(load_mw, {n}) OVER ({series} ORDER BY datetime) AS {name}" for name, n in lags.items())
    return f"SELECT event_id, {columns} FROM {READINGS}"


_LAGS = ("load_lag_1h", "load_lag_24h", "load_lag_48h", "load_lag_168h")


@query("lags_national", _lag_sql(""))
def lags_national(spark, folder):
    return history_features(readings(spark, folder).select("event_id", "datetime", "load_mw"), "datetime", "load_mw", rolls={}).select("event_id", *_LAGS)


@query("lags_per_city", _lag_sql("PARTITION BY city"))
def lags_per_city(spark, folder):
    r = readings(spark, folder).select("event_id", "city", "datetime", "load_mw")
    return history_features(r, "datetime", "load_mw", ["city"], rolls={}).select("event_id", *_LAGS)


def _roll_sql(function: str, name: str, series: str) -> str:
    parts = []
    for suffix, n in (("24h", 48), ("168h", 336)):
        frame = f"OVER ({series} ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts.append(f"CASE WHEN count(load_mw) {frame} = {n} THEN round({function}(load_mw) {frame}, 6) END AS load_roll_{name}_{suffix}")
    holes = f"(SELECT event_id, datetime, city, CASE WHEN event_id % 997 <> 5 THEN load_mw END AS load_mw FROM {READINGS})"
    return f"SELECT event_id, {', '.join(parts)} FROM {holes}"


def _with_holes(spark, folder):
    value = F.when(F.col("event_id") % 997 != 5, F.col("load_mw"))
    return readings(spark, folder).select("event_id", "datetime", "city", value.alias("load_mw"))


def _roll(spark, folder, name, series):
    out = [f"load_roll_{name}_{s}" for s in ("24h", "168h")]
    rolled = history_features(_with_holes(spark, folder), "datetime", "load_mw", series, lags={})
    return rounded(rolled.select("event_id", *out), *out)


@query("rolling_mean_national", _roll_sql("avg", "mean", ""))
def rolling_mean_national(spark, folder):
    return _roll(spark, folder, "mean", [])


@query("rolling_std_national", _roll_sql("stddev_samp", "std", ""))
def rolling_std_national(spark, folder):
    return _roll(spark, folder, "std", [])


@query("rolling_mean_per_city", _roll_sql("avg", "mean", "PARTITION BY city"))
def rolling_mean_per_city(spark, folder):
    return _roll(spark, folder, "mean", ["city"])


@query("rolling_std_per_city", _roll_sql("stddev_samp", "std", "PARTITION BY city"))
def rolling_std_per_city(spark, folder):
    return _roll(spark, folder, "std", ["city"])


def _continuity_sql(series: str, name: str, bucket: str, step: str) -> str:
    return f"""
    SELECT {name}, count(*) AS rows, min(t) AS min_dt, max(t) AS max_dt,
           CAST(count(*) FILTER (WHERE t - prev <> INTERVAL '{step}') AS BIGINT) AS n_bad_steps
    FROM (SELECT {name}, t, lag(t) OVER (PARTITION BY {name} ORDER BY t) AS prev
          FROM (SELECT DISTINCT {series} AS {name}, {bucket} AS t FROM {READINGS})) GROUP BY 1"""


@query("continuity_per_file", _continuity_sql("technology", "file", "time_bucket(INTERVAL 30 MINUTE, datetime)", "30 minutes"))
def continuity_per_file(spark, folder):
    r = readings(spark, folder).select(F.col("technology").alias("file"), step_floor("datetime", 30).alias("datetime"))
    return load_continuity(stage(r.distinct(), "continuity"))


@query("continuity_per_city", _continuity_sql("city", "city", "date_trunc('hour', datetime)", "1 hour"))
def continuity_per_city(spark, folder):
    r = readings(spark, folder).select("city", hour_floor("datetime").alias("datetime"))
    return weather_continuity(stage(r.distinct(), "continuity"))


@query(
    "coverage_summary",
    """SELECT count(*) AS rows, min(datetime) AS min_dt, max(datetime) AS max_dt,
              count(*) - count(DISTINCT date_trunc('hour', datetime)) AS duplicate_times, count(DISTINCT city) AS entities,
              array_to_string(list_sort(list(DISTINCT technology)), ',') AS kinds
       FROM (SELECT date_trunc('hour', datetime) AS datetime, city, technology FROM """ + READINGS + ")",
)
def coverage_summary(spark, folder):
    r = readings(spark, folder).withColumn("datetime", hour_floor("datetime"))
    return coverage(r, "datetime", "city", "technology").withColumn("kinds", F.array_join("kinds", ","))


@query(
    "history_on_time_grid",
    f"""WITH g AS (SELECT city, technology, date_trunc('hour', datetime) AS datetime, avg(load_mw) AS load_mw FROM {READINGS} GROUP BY 1, 2, 3),
        s AS (SELECT city, technology, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM g GROUP BY 1, 2),
        f AS (SELECT s.*, g.load_mw FROM s LEFT JOIN g USING (city, technology, datetime))
        SELECT city, technology, datetime, round(lag(load_mw, 24) OVER w, 6) AS load_lag_24h,
               CASE WHEN count(load_mw) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
                    THEN round(avg(load_mw) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS load_roll_mean_3h
        FROM f WINDOW w AS (PARTITION BY city, technology ORDER BY datetime)""",
)
def history_on_time_grid(spark, folder):
    """Lags and means as durations: sparse series on an hourly grid."""
    r = readings(spark, folder).select("city", "technology", "datetime", "load_mw")
    names = ["load_lag_24h", "load_roll_mean_3h"]
    timed = history_features(
        r, "datetime", "load_mw", ["city", "technology"], {names[0]: 24}, {"3h": 3}, mode="time", step_minutes=60
    )
    return rounded(timed.select("city", "technology", "datetime", *names), *names)
