"""The feature contract, feature tables, training and scoring."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loadweave.catalog.registry import HALF_HOUR_LOAD, HOURLY_WEATHER, VARIABLES, half_hour_load, hourly_weather, query, rounded, table
from loadweave.functions.text import finite
from loadweave.functions.timeutil import hour_floor, interval
from loadweave.operators.features import (
    CYCLIC,
    FEATURES,
    HISTORY,
    SOLAR_FEATURES,
    TARGET,
    WIND_FEATURES,
    cold_start,
    contract_of_maps,
    feature_table,
    features_from_maps,
    horizon_features,
    live_features,
    ordered_features,
)
from loadweave.plans.model import BoostingParams, backtest_report, score, score_requests, train, train_each, walk_forward
from loadweave.session import scratch_path, stage

# Which event types lack which features in the feature maps below.
_LACKING = {"error": ("cloud_cover",), "signup": ("hour", "month", "load_lag_1h")}


# Scoring is work for the processor, and a small file holds many requests: tasks are counted in rows, not in bytes.
REQUESTS_PER_TASK = 100_000


def _spread(events, rows_per_task: int = REQUESTS_PER_TASK):
    """Events dealt evenly over as many tasks as their rows are worth, however many splits their files have."""
    tasks = max(-(-events.count() // rows_per_task), 1)
    return events.repartition(tasks)


def _feature_maps(spark, folder, dealt=lambda events: events):
    """Per event a map of feature values; two event types lack some, one has a name too many.

    An event without a type lacks all that any type lacks. The maps are built
    from arrays, which Spark compiles; functions over array elements are
    interpreted row by row.
    """
    kind = F.col("event_type")
    values = {**{name: F.col("value") + i for i, name in enumerate(FEATURES)}, "pressure": F.col("value")}

    def request(lacking=(), extra=()):
        names = [name for name in values if name in extra or (name in FEATURES and name not in lacking)]
        return F.map_from_arrays(F.array(*[F.lit(name) for name in names]), F.array(*[values[name] for name in names]))

    requests = F.when(kind.isNull(), request({name for names in _LACKING.values() for name in names}))
    for lacking_kind, names in _LACKING.items():
        requests = requests.when(kind == lacking_kind, request(names))
    requests = requests.when(kind == "view", request(extra=("pressure",))).otherwise(request())
    events = dealt(table(spark, folder, "events").select("event_id", "event_type", "value"))
    return events.select("event_id", requests.alias("features"))


_MISSING_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{','.join(n for n in FEATURES if n in names)}'" for k, names in _LACKING.items()) + " ELSE '' END"


@query("contract_check", f"SELECT event_id, {_MISSING_SQL} AS missing, CASE WHEN event_type = 'view' THEN 'pressure' ELSE '' END AS extra FROM events")
def contract_check(spark, folder):
    checked = contract_of_maps(_feature_maps(spark, folder), "features")
    return checked.select("event_id", F.array_join("missing_features", ",").alias("missing"), F.array_join("extra_features", ",").alias("extra"))


@query(
    "contract_projection",
    f"""SELECT event_id, {", ".join(f"round(value + {i}, 6) AS {name}" for i, name in enumerate(FEATURES))} FROM events
        WHERE event_type NOT IN ('error', 'signup')""",
)
def contract_projection(spark, folder):
    return rounded(features_from_maps(_feature_maps(spark, folder), "features", keep=["event_id"]), *FEATURES)


def _features_sql() -> str:
    two_pi = repr(2 * math.pi)
    lags = ", ".join(f"lag(load_mw, {2 * h}) OVER w AS load_lag_{h}h" for h in (1, 24, 48, 168))
    rolls = []
    for h in (24, 168):
        frame = f"OVER (ORDER BY datetime ROWS BETWEEN {2 * h - 1} PRECEDING AND CURRENT ROW)"
        for function, name in (("avg", "mean"), ("stddev_samp", "std")):
            rolls.append(f"CASE WHEN count(load_mw) {frame} = {2 * h} THEN {function}(load_mw) {frame} END AS load_roll_{name}_{h}h")
    history = ", ".join(f"round({n}, 6) AS {n}" for n in HISTORY)
    weather = ", ".join(f"round(w.{v}, 6) AS {v}" for v in VARIABLES)
    return f"""
    WITH h AS (SELECT datetime, load_mw, {lags}, {', '.join(rolls)} FROM {HALF_HOUR_LOAD} WINDOW w AS (ORDER BY datetime)),
    j AS (SELECT h.*, w.* EXCLUDE (datetime), w.datetime AS hr FROM h JOIN {HOURLY_WEATHER} w ON date_trunc('hour', h.datetime) = w.datetime)
    SELECT datetime, round(load_mw, 6) AS load_mw, {weather.replace('w.', '')},
           CAST(hour(hr) AS INTEGER) AS hour, CAST(isodow(hr) - 1 AS INTEGER) AS dayofweek,
           CASE WHEN isodow(hr) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(month(hr) AS INTEGER) AS month, CAST(dayofyear(hr) AS INTEGER) AS dayofyear,
           round(sin({two_pi} * hour(hr) / 24.0), 6) AS hour_sin, round(cos({two_pi} * hour(hr) / 24.0), 6) AS hour_cos,
           round(sin({two_pi} * dayofyear(hr) / 366.0), 6) AS doy_sin, round(cos({two_pi} * dayofyear(hr) / 366.0), 6) AS doy_cos,
           {history} FROM j"""


_SHARP = (TARGET, *VARIABLES, *CYCLIC, *HISTORY)


@query("feature_table", _features_sql())
def feature_table_query(spark, folder):
    load = stage(half_hour_load(spark, folder), "load")
    return rounded(feature_table(load, hourly_weather(spark, folder)), *_SHARP)


@query("feature_order", f"SELECT {', '.join(FEATURES)} FROM ({_features_sql()})")
def feature_order(spark, folder):
    load = stage(half_hour_load(spark, folder), "load")
    return ordered_features(rounded(feature_table(load, hourly_weather(spark, folder)), *_SHARP))


@query(
    "live_feature_row",
    f"""SELECT {', '.join(f'w.{n} AS {n}' for n in FEATURES if n not in HISTORY)}, {', '.join(f'l.{n} AS {n}' for n in HISTORY)},
               TIMESTAMP '2024-01-20 12:00:00' AS datetime
        FROM (SELECT * FROM ({_features_sql()}) WHERE date_trunc('hour', datetime) = TIMESTAMP '2024-01-20 12:00:00' LIMIT 1) w,
             (SELECT * FROM ({_features_sql()}) ORDER BY datetime DESC LIMIT 1) l""",
)
def live_feature_row(spark, folder):
    row = live_features(half_hour_load(spark, folder), hourly_weather(spark, folder), "2024-01-20 12:10:00")
    return rounded(row, *VARIABLES, *CYCLIC, *HISTORY)


@query(
    "cold_start",
    """SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 0.0
                            ELSE max(value) FILTER (WHERE event_type = 'purchase' AND value > 20) END AS load_lag_1h
       FROM events GROUP BY 1""",
)
def cold_start_query(spark, folder):
    purchases = F.col("event_type") == "purchase"
    users = table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.when(purchases, 1)).alias("history_rows"),
        F.max(F.when(purchases & (F.col("value") > 20), F.col("value"))).alias("load_lag_1h"),
    )
    return cold_start(users, F.col("history_rows"), ["load_lag_1h"]).drop("history_rows")


HORIZON = 24
PARAMS = BoostingParams()  # as declared: 500 trees
_STORED: dict[tuple[str, str], str] = {}


def forecast_rows(spark, folder):
    """Features of every half hour and the load a day later as ``target``."""
    load = stage(half_hour_load(spark, folder), "load")
    return horizon_features(feature_table(load, hourly_weather(spark, folder)), "datetime", TARGET, HORIZON)


def stored_model(spark, folder) -> PipelineModel:
    """The day-ahead model with the declared parameters: fitted once per folder and session, saved, and loaded."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        path = scratch_path(spark, "model")
        train(stage(forecast_rows(spark, folder), "features"), label="target", params=PARAMS).write().overwrite().save(path)
        _STORED[key] = path
    return PipelineModel.load(_STORED[key])


# Every feature row, its target time, the load there, and how many features have no value.
_FILLED_SQL = " + ".join(f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in FEATURES)
_FORECAST_SQL = f"""
  SELECT f.datetime, f.datetime + INTERVAL {HORIZON} HOUR AS target_time, round(t.load_mw, 6) AS target, CAST({_FILLED_SQL.replace("WHEN ", "WHEN f.")} AS INTEGER) AS filled, true AS scored
  FROM ({_features_sql()}) f LEFT JOIN {HALF_HOUR_LOAD} t ON t.datetime = f.datetime + INTERVAL {HORIZON} HOUR
  {{where}}
"""


def answered(name: str):
    """Whether a stored prediction has a finite value.

    Before it is stored, a prediction of Spark ML counts as never null: the
    optimizer then drops the model from plans that only ask for a value.
    """
    return finite(name).isNotNull()


def _forecast(scored):
    later = (F.col("datetime") + interval(hours=HORIZON)).alias("target_time")
    kept = stage(scored.select("datetime", "target", "filled", "prediction"), "scored")
    return kept.select("datetime", later, F.round("target", 6).alias("target"), F.col("filled").cast("int").alias("filled"), answered("prediction").alias("scored"))


@query("train_and_score_load", _FORECAST_SQL.format(where=""))
def train_and_score_load(spark, folder):
    """Trains the day-ahead model and answers every feature row, those with missing values too."""
    return _forecast(score(stored_model(spark, folder), forecast_rows(spark, folder)))


@query("score_stored_model", f"SELECT datetime, true AS scored FROM ({_features_sql()})")
def score_stored_model(spark, folder):
    """A model saved, loaded and applied to all feature rows."""
    load = stage(half_hour_load(spark, folder), "load")
    rows = feature_table(load, hourly_weather(spark, folder))
    scored = stage(score(stored_model(spark, folder), rows).select("datetime", "prediction"), "scored")
    return scored.select("datetime", answered("prediction").alias("scored"))


@query(
    "score_requests",
    f"""SELECT event_id, event_type NOT IN ('error', 'signup') AS scored,
               CAST(CASE event_type {" ".join(f"WHEN '{k}' THEN {len(names)}" for k, names in _LACKING.items())} ELSE 0 END AS INTEGER) AS missing,
               CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS INTEGER) AS extra FROM events""",
)
def score_requests_query(spark, folder):
    """Feature maps of all events, most of them incomplete or with a name too many."""
    result = score_requests(stored_model(spark, folder), _feature_maps(spark, folder, _spread))
    result = stage(result.select("event_id", "prediction", "missing_features", "extra_features"), "scored")
    return result.select("event_id", answered("prediction").alias("scored"), F.size("missing_features").alias("missing"), F.size("extra_features").alias("extra"))


@query(
    "train_and_score_generation",
    f"""WITH g AS (SELECT date_trunc('hour', ts) AS datetime, round(sum(value) FILTER (WHERE event_type = 'view'), 6) AS wind_mw,
                          round(sum(value) FILTER (WHERE event_type = 'click'), 6) AS solar_mw FROM events GROUP BY 1)
        SELECT g.datetime, t.wind_mw, t.solar_mw, true AS wind_scored, true AS solar_scored
        FROM g LEFT JOIN g t ON t.datetime = g.datetime + INTERVAL {HORIZON} HOUR""",
)
def train_and_score_generation(spark, folder):
    """Day-ahead wind and solar models with their own feature lists; the outputs shown are those a day later."""
    e = table(spark, folder, "events")
    output = e.groupBy(hour_floor("ts").alias("datetime")).agg(
        F.round(F.sum(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("wind_mw"),
        F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), 6).alias("solar_mw"),
    )
    weather = hourly_weather(spark, folder).withColumns({"hour_of_day": F.hour("datetime"), "day_of_year": F.dayofyear("datetime")})
    rows = stage(output.join(weather, "datetime"), "generation")
    for label in ("wind_mw", "solar_mw"):
        rows = horizon_features(rows, "datetime", label, HORIZON).drop(label).withColumnRenamed("target", label)
    result = stage(rows, "generation")
    wanted = [(WIND_FEATURES, "wind_mw"), (SOLAR_FEATURES, "solar_mw")]
    for (features, label), model in zip(wanted, train_each(result, wanted, PARAMS)):
        result = score(model, result, features).withColumnRenamed("prediction", label.replace("mw", "prediction")).drop("filled")
    result = stage(result.select("datetime", "wind_mw", "solar_mw", "wind_prediction", "solar_prediction"), "scored")
    return result.select("datetime", "wind_mw", "solar_mw", answered("wind_prediction").alias("wind_scored"), answered("solar_prediction").alias("solar_scored"))


# Every day is a fold with a model of its own; all of them with the declared 500 trees take over an hour on 8 cores.
BACKTEST_TREES = 20


def _backtest(spark, folder):
    params = replace(PARAMS, trees=min(PARAMS.trees, BACKTEST_TREES))
    return backtest_report(walk_forward(forecast_rows(spark, folder), "datetime", "target", horizon_hours=HORIZON, params=params))


_BACKTEST_SQL = f"""
  SELECT date_trunc('day', f.datetime + INTERVAL {HORIZON} HOUR) AS day, count(*) AS n
  FROM ({_features_sql()}) f JOIN {HALF_HOUR_LOAD} t ON t.datetime = f.datetime + INTERVAL {HORIZON} HOUR
  WHERE t.load_mw IS NOT NULL
  GROUP BY 1
  QUALIFY day > min(day) OVER ()
"""


@query("walk_forward_backtest", f"SELECT day, n, true AS measured FROM ({_BACKTEST_SQL})")
def walk_forward_backtest(spark, folder):
    """Each day is forecast by a model of the days before it; one row per day that has any."""
    daily, _ = _backtest(spark, folder)
    measured = F.col("daily_mape_pct").isNotNull() & F.col("daily_mae_mw").isNotNull() & F.col("daily_rmse_mw").isNotNull()
    return daily.select("day", "n", measured.alias("measured"))
