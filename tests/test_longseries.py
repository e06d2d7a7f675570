import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.functions.timeutil import interval
from loadweave.operators import longseries as L
from loadweave.operators.quality import continuity, coverage
from loadweave.operators.windows import history_features, previous_time, step_to_previous

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """Three series; one holds most rows, one has a null name, times have gaps and values have nulls."""
    rng = random.Random(7)
    rows = []
    for name, n in (("big", 1500), ("small", 60), (None, 90)):
        minute = 0
        for _ in range(n):
            minute += rng.choice([30, 30, 30, 60, 600])
            value = None if rng.random() < 0.02 else rng.choice([float("nan"), 5.0] + [rng.uniform(1e4, 9e4)] * 18)
            rows.append((name, START + timedelta(minutes=minute), value))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "name string, datetime timestamp_ntz, load_mw double").cache()


def test_row_numbers(spark, series):
    got = L.number_rows(series, "datetime", ["name"], "row", pieces=7).toPandas()
    assert len(got) == 1650
    for _, part in got.groupby("name", dropna=False):
        assert list(part.sort_values("datetime")["row"]) == list(range(len(part)))


def test_row_numbers_without_series(spark, series):
    big = series.where("name = 'big'")
    got = L.number_rows(big, "datetime", pieces=5).orderBy("datetime").toPandas()
    assert list(got["row"]) == list(range(1500))


def test_split_points_never_change_results(spark, series):
    big = series.where("name = 'big'")
    results = [
        sorted(map(tuple, step_to_previous(big, "datetime", pieces=n).select("datetime", "step").collect())) for n in (2, 3, 50)
    ]
    assert results[0] == results[1] == results[2]


def test_rows_without_order_value_stay(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (3.0,)], "x double")
    assert sorted(r["row"] for r in L.number_rows(df, "x", pieces=2).collect()) == [0, 1, 2, 3]


LAGS = {"load_lag_1h": 2, "load_lag_24h": 48}
ROLLS = {"24h": 48, "1h": 2}
NAMES = [*LAGS, *[f"load_roll_{k}_{s}" for s in ROLLS for k in ("mean", "std")]]


def test_chunk_plan_equals_pandas_and_series_plan(spark, series):
    keyed = ["name", "datetime"]
    chunked = history_features(series, "datetime", "load_mw", ["name"], LAGS, ROLLS, chunk=64, pieces=5)
    simple = history_features(series, "datetime", "load_mw", ["name"], LAGS, ROLLS, plan="series")
    a = chunked.select(*keyed, *NAMES).toPandas().sort_values(keyed).reset_index(drop=True)
    b = simple.select(*keyed, *NAMES).toPandas().sort_values(keyed).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-6)
    source = series.toPandas()
    for name, part in source.groupby("name", dropna=False):
        part = part.sort_values("datetime").reset_index(drop=True)
        mine = a[a["name"].isna() if name is None or name != name else a["name"] == name].reset_index(drop=True)
        v = part["load_mw"]
        for column, n in LAGS.items():
            np.testing.assert_allclose(mine[column].astype(float), v.shift(n), equal_nan=True)
        for suffix, n in ROLLS.items():
            np.testing.assert_allclose(mine[f"load_roll_mean_{suffix}"].astype(float), v.rolling(n).mean(), rtol=1e-9, equal_nan=True)
            np.testing.assert_allclose(mine[f"load_roll_std_{suffix}"].astype(float), v.rolling(n).std(), rtol=1e-6, atol=1e-3, equal_nan=True)


def test_constant_window_has_no_deviation(spark):
    rows = [(START + timedelta(hours=i), 0.1 if i < 50 else 71234.56789) for i in range(150)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, load_mw double")
    got = history_features(df, "datetime", "load_mw", lags={}, rolls={"w": 20}, chunk=32).orderBy("datetime").toPandas()["load_roll_std_w"]
    assert got[:19].isna().all() and (got[19:50] == 0).all() and (got[69:] == 0).all() and (got[50:69] > 0).all()


def test_full_window_lengths(spark):
    for n, filled in ((335, 0), (336, 1), (337, 2)):
        rows = [(START + timedelta(minutes=30 * i), float(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "datetime timestamp_ntz, load_mw double")
        got = history_features(df, "datetime", "load_mw").toPandas()
        assert got["load_roll_mean_168h"].notna().sum() == filled
        assert got["load_lag_168h"].notna().sum() == max(0, n - 336)


def test_halo_must_fit(spark, series):
    with pytest.raises(ValueError):
        L.with_halo(series.withColumn("row", F.lit(0)), "row", 4, before=5)


def test_previous_time_per_series(spark, series):
    got = previous_time(series, "datetime", ["name"], pieces=6).toPandas()
    for _, part in got.groupby("name", dropna=False):
        part = part.sort_values("datetime")
        assert list(part["previous"].iloc[1:]) == list(part["datetime"].iloc[:-1]) and pd.isna(part["previous"].iloc[0])


@pytest.mark.parametrize("inclusive", [True, False])
def test_carried_both_ways(spark, inclusive):
    values = [None, None, 3, None, 5, None, None, None, 9, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int")
    cut = L.with_pieces(df, "i", cuts=[2.0, 4.0, 5.0, 7.0])
    got = L.carried(cut, "i", last={"a": F.col("v")}, first={"b": F.col("v")}, inclusive=inclusive).orderBy("i").collect()
    step = 0 if inclusive else 1
    for i, row in enumerate(got):
        before = [v for v in values[: i + 1 - step] if v is not None]
        after = [v for v in values[i + step :] if v is not None]
        assert row["a"] == (before[-1] if before else None)
        assert row["b"] == (after[0] if after else None)


def test_exact_quantiles_with_ties(spark):
    rng = random.Random(3)
    values = [0.0] * 400 + [rng.choice([1.5, 2.5, rng.random() * 100]) for _ in range(801)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    shares = [0.0, 0.2, 0.5, 0.95, 0.999, 1.0]
    np.testing.assert_allclose(L.exact_quantiles(df, "x", shares), np.quantile(values, shares))
    assert L.exact_quantiles(df.where("x < 0"), "x", [0.5]) == [None]


def test_continuity_across_pieces(spark, series):
    unique = series.select("name", "datetime")
    got = {r["name"]: r for r in continuity(unique, "datetime", ["name"], interval(minutes=30), pieces=9).collect()}
    source = series.toPandas()
    for name, part in source.groupby("name", dropna=False):
        key = None if pd.isna(name) else name
        steps = part.sort_values("datetime")["datetime"].diff().dropna()
        assert got[key]["rows"] == len(part)
        assert got[key]["n_bad_steps"] == int((steps != pd.Timedelta("30min")).sum())
        assert got[key]["min_dt"] == part["datetime"].min().to_pydatetime()


def test_coverage_with_null_times(spark):
    df = spark.createDataFrame([(START, "a"), (START, "b"), (None, "a"), (None, None)], "t timestamp_ntz, k string")
    row = coverage(df, "t", kind="k").first()
    assert (row["rows"], row["duplicate_times"], row["kinds"]) == (4, 2, ["a", "b"])


def test_more_rows_make_more_pieces():
    assert L.default_pieces(10, 8) == 16
    assert L.default_pieces(50 * L.ROWS_PER_PIECE, 8) == 50
