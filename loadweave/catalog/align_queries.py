"""Means, resampling, joins, lookups, sorting, retention, metrics, stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.registry import (
    HALF_HOUR_LOAD,
    HOURLY_WEATHER,
    READINGS,
    SCALES,
    VARIABLES,
    WEATHER_ROWS,
    half_hour_load,
    hourly_weather,
    query,
    readings,
    rounded,
    table,
    weather_rows,
)
from loadweave.functions.timeutil import hour_floor, step_floor
from loadweave.operators import align as A
from loadweave.operators.backtest import daily_metrics, walk_forward_folds, walk_forward_roles, with_persistence
from loadweave.operators.dedup import keep_first
from loadweave.operators.stress import fill_gaps, flag_extreme, residual_load
from loadweave.plans.datasets import hourly_dataset as hourly

_ROUNDED = ", ".join(f"round({v}, 6) AS {v}" for v in VARIABLES)


@query("national_mean", f"SELECT datetime, {_ROUNDED} FROM {HOURLY_WEATHER}")
def national_mean(spark, folder):
    w = weather_rows(spark, folder).withColumn("datetime", hour_floor("datetime"))
    return rounded(A.national_mean(w, exclude=("city", "event_id")), *VARIABLES)


_CITIES = """(SELECT c_nationkey AS city, count(*) AS population FROM customer GROUP BY 1)"""
_WEIGHTS = f"(SELECT city, population, population / (SELECT count(*) FROM customer) AS weight FROM {_CITIES})"


def _cities(spark, folder):
    return table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("city")).agg(F.count(F.lit(1)).alias("population"))


@query("city_weights", f"SELECT city, population, round(weight, 9) AS weight FROM {_WEIGHTS}")
def city_weights(spark, folder):
    return rounded(A.city_weights(_cities(spark, folder)), "weight", digits=9)


@query(
    "weighted_national_mean",
    f"""SELECT date_trunc('hour', datetime) AS datetime,
               round(sum(weight * temperature_2m) / sum(weight), 6) AS temperature_2m,
               round(sum(weight * cloud) / sum(CASE WHEN cloud IS NOT NULL THEN weight END), 6) AS cloud_cover
        FROM (SELECT *, nullif(cloud_cover, 0) AS cloud FROM {WEATHER_ROWS}) JOIN {_WEIGHTS} USING (city) GROUP BY 1""",
)
def weighted_national_mean(spark, folder):
    w = weather_rows(spark, folder).withColumns({"datetime": hour_floor("datetime"), "cloud_cover": F.nullif("cloud_cover", F.lit(0.0))})
    weights = A.city_weights(_cities(spark, folder))
    return rounded(A.weighted_mean(w, weights, ["temperature_2m", "cloud_cover"]), "temperature_2m", "cloud_cover")


def _grid_sql(source: str, keys: tuple[str, ...] = ()) -> str:
    """Hourly means of each series with its empty hours."""
    listed = "".join(f"{k}, " for k in keys)
    return f"""(SELECT {"".join(f"s.{k}, " for k in keys)}s.datetime, g.load_mw FROM
      (SELECT {listed}unnest(generate_series(date_trunc('hour', min(datetime)), date_trunc('hour', max(datetime)), INTERVAL 1 HOUR)) AS datetime
       FROM {source} {"GROUP BY " + ", ".join(keys) if keys else ""}) s
      LEFT JOIN (SELECT {listed}date_trunc('hour', datetime) AS datetime, avg(load_mw) AS load_mw FROM {source} GROUP BY ALL) g
        ON {"".join(f"s.{k} = g.{k} AND " for k in keys)}s.datetime = g.datetime)"""


# Readings per city and technology are sparse: most of their hours are empty.
SPARSE_KEYS = ("city", "technology")
_SCALED = f"(SELECT city, technology, datetime, load_mw * CAST({SCALES[0]} AS DOUBLE) AS load_mw FROM {READINGS})"


@query("hourly_resample_gaps", f"SELECT city, technology, datetime, round(load_mw, 6) AS load_mw FROM {_grid_sql(READINGS, SPARSE_KEYS)}")
def hourly_resample_gaps(spark, folder):
    return rounded(A.resample_mean(readings(spark, folder), keys=SPARSE_KEYS), "load_mw")


@query(
    "hourly_resample_per_city",
    f"""WITH g AS (SELECT city, date_trunc('hour', datetime) AS datetime, avg(load_mw) AS load_mw FROM {READINGS} GROUP BY 1, 2),
        s AS (SELECT city, unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM g GROUP BY 1)
        SELECT s.city, s.datetime, round(g.load_mw, 6) AS load_mw FROM s LEFT JOIN g ON s.city = g.city AND s.datetime = g.datetime""",
)
def hourly_resample_per_city(spark, folder):
    r = readings(spark, folder).select("city", "datetime", "load_mw")
    return rounded(A.resample_mean(r, keys=["city"]), "load_mw")


@query(
    "hourly_dataset",
    f"""SELECT datetime, round(l.load_mw, 6) AS load_mw, {_ROUNDED} FROM
        {_grid_sql(_SCALED)} l JOIN {HOURLY_WEATHER} w USING (datetime)""",
)
def hourly_dataset(spark, folder):
    r = readings(spark, folder).select("datetime", (F.col("load_mw") * SCALES[0]).alias("load_mw"), "event_id")
    load = keep_first(r, ["datetime"], ["event_id"]).select("datetime", "load_mw")
    return rounded(hourly(load, hourly_weather(spark, folder)), "load_mw", *VARIABLES)


@query(
    "hourly_join",
    f"""SELECT city, technology, datetime, round(load_mw, 6) AS load_mw, round(cloud_cover, 6) AS cloud_cover
        FROM {_grid_sql(READINGS, SPARSE_KEYS)} JOIN {HOURLY_WEATHER} USING (datetime)""",
)
def hourly_join(spark, folder):
    load = A.resample_mean(readings(spark, folder), keys=SPARSE_KEYS)
    joined = A.align_hourly(load, hourly_weather(spark, folder).select("datetime", "cloud_cover"))
    return rounded(joined, "load_mw", "cloud_cover")


@query(
    "combine_first",
    f"""WITH n AS (SELECT date_trunc('hour', datetime) AS datetime, max(CASE WHEN load_mw > 5 THEN load_mw END) AS load_mw
                   FROM {READINGS} WHERE event_id % 2 = 0 GROUP BY 1),
             o AS (SELECT date_trunc('hour', datetime) AS datetime, max(load_mw) AS load_mw FROM {READINGS} WHERE event_id % 2 = 1 GROUP BY 1)
        SELECT datetime, coalesce(n.load_mw, o.load_mw) AS load_mw FROM n FULL JOIN o USING (datetime)""",
)
def combine_first(spark, folder):
    """Every event is on one of the two sides."""
    r = readings(spark, folder).withColumn("datetime", hour_floor("datetime"))
    new = r.where(F.col("event_id") % 2 == 0).groupBy("datetime").agg(F.max(F.when(F.col("load_mw") > 5, F.col("load_mw"))).alias("load_mw"))
    old = r.where(F.col("event_id") % 2 == 1).groupBy("datetime").agg(F.max("load_mw").alias("load_mw"))
    return A.combine_first(new, old, "datetime", ["load_mw"])


_LOOKUP = f"(SELECT datetime AS known, max(load_mw) AS known_mw FROM {READINGS} WHERE technology = 'view' GROUP BY 1)"


@query(
    "nearest_lookup",
    f"""SELECT event_id, datetime,
          CASE WHEN f.known IS NULL THEN c.known WHEN c.known IS NULL THEN f.known
               WHEN datetime - f.known <= c.known - datetime THEN f.known ELSE c.known END AS known,
          CASE WHEN f.known IS NULL THEN c.known_mw WHEN c.known IS NULL THEN f.known_mw
               WHEN datetime - f.known <= c.known - datetime THEN f.known_mw ELSE c.known_mw END AS known_mw
        FROM (SELECT event_id, datetime FROM {READINGS}) r
        ASOF LEFT JOIN {_LOOKUP} f ON r.datetime >= f.known
        ASOF LEFT JOIN {_LOOKUP} c ON r.datetime <= c.known""",
)
def nearest_lookup(spark, folder):
    targets = readings(spark, folder).select("event_id", "datetime")
    views = readings(spark, folder).where(F.col("technology") == "view")
    lookup = views.groupBy(F.col("datetime").alias("known")).agg(F.max("load_mw").alias("known_mw"))
    return A.nearest_join(targets, lookup, "datetime", "known")


@query(
    "nearest_row",
    f"""SELECT datetime, {_ROUNDED} FROM {HOURLY_WEATHER}
        ORDER BY abs(epoch(datetime) - epoch(TIMESTAMP '2024-01-20 12:30:00')), datetime LIMIT 1""",
)
def nearest_row(spark, folder):
    return rounded(A.nearest_row(hourly_weather(spark, folder), "datetime", "2024-01-20 12:30:00"), *VARIABLES)


@query("time_sorted", "SELECT datetime, city, load_mw FROM " + READINGS + " ORDER BY datetime")
def time_sorted(spark, folder):
    return readings(spark, folder).select("datetime", "city", "load_mw").orderBy("datetime")


@query("latest_row", "SELECT datetime, load_mw FROM " + READINGS + " ORDER BY datetime DESC LIMIT 1")
def latest_row(spark, folder):
    return A.latest_row(readings(spark, folder).select("datetime", "load_mw"), "datetime")


@query("latest_row_per_city", "SELECT city, max(datetime) AS datetime, arg_max(load_mw, datetime) AS load_mw FROM " + READINGS + " GROUP BY 1")
def latest_row_per_city(spark, folder):
    return A.latest_row(readings(spark, folder).select("city", "datetime", "load_mw"), "datetime", ["city"])


@query(
    "union_by_name",
    f"""SELECT datetime, load_mw, city FROM {READINGS} WHERE technology = 'view'
        UNION ALL SELECT datetime, load_mw, NULL FROM {READINGS} WHERE technology <> 'view'""",
)
def union_by_name(spark, folder):
    r = readings(spark, folder)
    first = r.where(F.col("technology") == "view").select("datetime", "load_mw", "city")
    return A.union_all(first, r.where(F.col("technology") != "view").select("load_mw", "datetime"))


@query("retention", "SELECT datetime, load_mw FROM " + READINGS + " WHERE datetime > TIMESTAMP '2024-01-18 06:00:00'")
def retention(spark, folder):
    return A.retain(readings(spark, folder).select("datetime", "load_mw"), "datetime", "2024-01-28 06:00:00")


_HOURLY_LOAD = f"(SELECT date_trunc('hour', datetime) AS datetime, avg(load_mw) AS load_mw FROM {READINGS} GROUP BY 1)"


def _hourly_load(spark, folder):
    return readings(spark, folder).groupBy(hour_floor("datetime").alias("datetime")).agg(F.avg("load_mw").alias("load_mw"))


@query(
    "daily_backtest_metrics",
    f"""SELECT date_trunc('day', a.datetime) + INTERVAL 0 DAY AS day,
               round(avg(abs(f.load_mw - a.load_mw) / nullif(abs(a.load_mw), 0)) * 100, 6) AS daily_mape_pct,
               round(avg(abs(f.load_mw - a.load_mw)), 6) AS daily_mae_mw,
               round(sqrt(avg((f.load_mw - a.load_mw) * (f.load_mw - a.load_mw))), 6) AS daily_rmse_mw, count(*) AS n
        FROM {_HOURLY_LOAD} a JOIN {_HOURLY_LOAD} f ON f.datetime = a.datetime - INTERVAL 24 HOUR GROUP BY 1""",
)
def daily_backtest_metrics(spark, folder):
    forecast = with_persistence(_hourly_load(spark, folder), "datetime", "load_mw")
    metrics = daily_metrics(forecast, "datetime", "load_mw", "forecast")
    return rounded(metrics, "daily_mape_pct", "daily_mae_mw", "daily_rmse_mw")


@query(
    "walk_forward_folds",
    """WITH d AS (SELECT CAST(ts AS DATE) + INTERVAL 0 DAY AS fold, count(*) AS n, min(ts) AS first FROM events GROUP BY 1),
       f AS (SELECT fold, n, CAST(sum(n) OVER w AS BIGINT) AS train_rows, min(first) OVER w AS train_start FROM d
             WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       SELECT fold, train_start, fold AS train_end, fold + INTERVAL 24 HOUR AS test_end, train_rows, n AS test_rows
       FROM f WHERE train_rows > 0""",
)
def walk_forward_folds_query(spark, folder):
    return walk_forward_folds(readings(spark, folder).select("datetime"), "datetime")


@query(
    "walk_forward_roles",
    """SELECT event_id, CAST(ts AS DATE) + INTERVAL 1 DAY AS first_train_fold, CAST(ts AS DATE) + INTERVAL 0 DAY AS test_fold FROM events""",
)
def walk_forward_roles_query(spark, folder):
    roles = walk_forward_roles(readings(spark, folder).select("event_id", "datetime"), "datetime")
    return roles.select("event_id", "first_train_fold", F.explode("test_folds").alias("test_fold"))


@query(
    "residual_load",
    f"""SELECT datetime, round(l.load_mw, 6) AS load_mw, round(wind_mw, 6) AS wind_mw, round(solar_mw, 6) AS solar_mw,
               round(l.load_mw - wind_mw - solar_mw, 6) AS residual_mw
        FROM {HALF_HOUR_LOAD} l LEFT JOIN (
          SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS datetime, coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0) AS wind_mw,
                 coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS solar_mw
          FROM events WHERE event_type IN ('view', 'click') GROUP BY 1) g USING (datetime)""",
)
def residual_load_query(spark, folder):
    generation = readings(spark, folder).select(
        step_floor("datetime", 30).alias("datetime"), F.col("technology").alias("production_type"), F.col("load_mw").alias("value_mw")
    )
    result = residual_load(half_hour_load(spark, folder), generation, wind="view", solar="click")
    return rounded(result, "load_mw", "wind_mw", "solar_mw", "residual_mw")


@query(
    "extreme_demand",
    """SELECT event_id, CASE WHEN value >= (SELECT quantile_cont(value, 0.95) FROM events) THEN 1 ELSE 0 END AS is_extreme FROM events""",
)
def extreme_demand(spark, folder):
    return flag_extreme(readings(spark, folder).select("event_id", "load_mw")).select("event_id", "is_extreme")


@query(
    "gap_fill",
    f"""WITH g AS (SELECT * FROM {_grid_sql(_SCALED, SPARSE_KEYS)}),
        k AS (SELECT g.city, g.technology, g.datetime, g.load_mw, w.load_mw AS week, coalesce(g.load_mw, w.load_mw) AS known
              FROM g LEFT JOIN g w ON w.city = g.city AND w.technology = g.technology AND w.datetime = g.datetime - INTERVAL 7 DAY),
        p AS (SELECT *, max(CASE WHEN known IS NOT NULL THEN datetime END) OVER (w ROWS UNBOUNDED PRECEDING) AS t0,
                     min(CASE WHEN known IS NOT NULL THEN datetime END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
              FROM k WINDOW w AS (PARTITION BY city, technology ORDER BY datetime))
        SELECT p.city, p.technology, p.datetime,
               round(coalesce(p.known, a.known + (b.known - a.known) * (epoch(p.datetime) - epoch(t0)) / nullif(epoch(t1) - epoch(t0), 0)), 6) AS load_mw,
               CASE WHEN p.load_mw IS NOT NULL THEN 'observed' WHEN p.week IS NOT NULL THEN 'last_week'
                    WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN 'interpolated' END AS filled_from
        FROM p LEFT JOIN k a ON a.city = p.city AND a.technology = p.technology AND a.datetime = t0
               LEFT JOIN k b ON b.city = p.city AND b.technology = p.technology AND b.datetime = t1""",
)
def gap_fill(spark, folder):
    r = readings(spark, folder).select(*SPARSE_KEYS, "datetime", (F.col("load_mw") * SCALES[0]).alias("load_mw"))
    return rounded(fill_gaps(r, keys=SPARSE_KEYS), "load_mw")
