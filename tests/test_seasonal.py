"""The seasonal model against numpy least squares."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.functions.calendar import holiday_table
from loadweave.operators.seasonal import fill_gaps_by_season, fit_seasonal, seasonal_terms

START = datetime(2024, 1, 1)
SCHEMA = "datetime timestamp_ntz, load_mw double"


def series(hours, noise=0.0):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(hours):
        d = i / 24
        holiday = (START + timedelta(hours=i)).date() == START.date()
        value = 50 + 3 * d / 100 + 7 * math.sin(2 * math.pi * d) - 2 * math.cos(4 * math.pi * d / 7) - 10 * holiday
        rows.append((START + timedelta(hours=i), value + noise * rng.normal()))
    return rows


def test_weights_equal_numpy(spark):
    rows = series(24 * 30, noise=1.0) + [(START + timedelta(days=40), None), (START + timedelta(days=41), math.nan)]
    knot = START + timedelta(days=12)
    waves = {"day": (1.0, 1), "week": (7.0, 2)}
    found = fit_seasonal(spark.createDataFrame(rows, SCHEMA), seasonal_terms("datetime", START, waves, [knot]), "load_mw")
    d = np.arange(24 * 30) / 24
    columns = [np.ones_like(d), d / 100, np.maximum(d - 12, 0) / 100]
    for period, count in waves.values():
        for k in range(1, count + 1):
            columns += [np.sin(2 * math.pi * k * d / period), np.cos(2 * math.pi * k * d / period)]
    wanted = np.linalg.lstsq(np.column_stack(columns), np.array([v for _, v in rows[: len(d)]]), rcond=None)[0]
    assert list(found.values()) == pytest.approx(wanted.tolist(), rel=1e-6, abs=1e-6)


def test_holes_take_week_then_season(spark):
    rows = series(24 * 28)
    hole = lambda i: 30 <= i < 60 or 400 <= i < 420 or 240 <= i < 245 or 408 <= i < 413
    given = [row for i, row in enumerate(rows) if not hole(i)]
    waves = {"day": (1.0, 2), "week": (7.0, 2)}
    filled = fill_gaps_by_season(spark.createDataFrame(given, SCHEMA), waves=waves, holidays=holiday_table(spark, 2024, 2024)).orderBy("datetime").collect()
    assert len(filled) == len(rows)
    for i, (row, (time, value)) in enumerate(zip(filled, rows)):
        assert row.datetime == time
        if not hole(i):
            assert row.filled_from == "observed" and row.load_mw == pytest.approx(value)
        elif i >= 168 and not hole(i - 168):
            assert row.filled_from == "last_week" and row.load_mw == pytest.approx(rows[i - 168][1])
        else:
            assert row.filled_from == "season" and row.load_mw == pytest.approx(value, abs=1e-5)
    assert {r.filled_from for r in filled} == {"observed", "last_week", "season"}


def test_series_without_values(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fill_gaps_by_season(empty).count() == 0
    blank = spark.createDataFrame([(START, None), (START + timedelta(hours=2), None)], SCHEMA)
    assert fill_gaps_by_season(blank).where(F.col("load_mw").isNotNull() | F.col("filled_from").isNotNull()).count() == 0
