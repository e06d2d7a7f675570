import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.operators import align as A
from loadweave.operators import features as N
from loadweave.operators.backtest import daily_metrics, fold_rows, walk_forward_folds, walk_forward_roles
from loadweave.operators.dedup import keep_first, keep_last, mean_per_key
from loadweave.operators.stress import fill_gaps, flag_extreme, residual_load

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


@pytest.mark.parametrize("partitions", [1, 5])
def test_first_and_last_do_not_depend_on_scan_order(spark, partitions):
    rows = [("a", "f2", 1, 1.0), ("a", "f1", 9, 2.0), ("a", "f1", 3, None), (None, "f1", 5, 4.0), (None, "f1", 4, 5.0)]
    random.Random(partitions).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, file string, id long, v double").repartition(partitions)
    assert {r["k"]: r["v"] for r in keep_first(df, ["k"], ["file", "id"]).collect()} == {"a": None, None: 5.0}
    assert {r["k"]: r["v"] for r in keep_last(df, ["k"], ["file", "id"]).collect()} == {"a": 1.0, None: 4.0}
    assert {r["k"]: r["v"] for r in keep_first(df.drop("file"), ["k"], ["id"]).collect()} == {"a": 1.0, None: 5.0}


def test_null_order_means_the_same_for_all_column_types(spark):
    rows = [(1, None, 1.0), (1, 5, 2.0), (2, None, 3.0)]
    fixed = spark.createDataFrame(rows, "k int, o int, v double")
    wide = fixed.withColumn("t", F.lit("text"))
    firm = spark.createDataFrame([(1, 4, 1.0), (1, 5, 2.0)], "k int, o int, v double").withColumn("o", F.coalesce("o", F.lit(0)))
    for df in (fixed, wide):
        assert {(r["k"], r["o"], r["v"]) for r in keep_first(df, ["k"], ["o"]).collect()} == {(1, None, 1.0), (2, None, 3.0)}
        assert {(r["k"], r["o"], r["v"]) for r in keep_last(df, ["k"], ["o"]).collect()} == {(1, 5, 2.0), (2, None, 3.0)}
    assert not firm.schema["o"].nullable
    assert [(r["o"], r["v"]) for r in keep_first(firm, ["k"], ["o"]).collect()] == [(4, 1.0)]
    assert [(r["o"], r["v"]) for r in keep_last(firm, ["k"], ["o"]).collect()] == [(5, 2.0)]


def test_mean_keeps_null_keys_and_skips_null_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, 4.0), (1, "x", None), (1, "x", 3.0)], "d int, statut string, v double")
    assert {r["statut"]: r["v"] for r in mean_per_key(df, ["d", "statut"], "v").collect()} == {None: 3.0, "x": 3.0}


def test_resample_labels_and_gaps(spark):
    df = spark.createDataFrame([(at(0.25), 1.0), (at(0.5), float("nan")), (at(3), 4.0), (None, 9.0)], "datetime timestamp_ntz, load_mw double")
    assert [tuple(r) for r in A.resample_mean(df).orderBy("datetime").collect()] == [(at(0), 1.0), (at(1), None), (at(2), None), (at(3), 4.0)]
    assert A.resample_mean(df, minutes=30).count() == 7
    assert A.resample_mean(df.where("load_mw = 100")).count() == 0
    with pytest.raises(ValueError):
        A.resample_mean(df, minutes=50)


def test_national_means(spark):
    w = spark.createDataFrame(
        [("a", at(0), 1.0, 4), ("b", at(0), None, 8), ("a", at(1), float("nan"), 2)], "city string, datetime timestamp_ntz, t double, c int"
    )
    assert [tuple(r) for r in A.national_mean(w).orderBy("datetime").collect()] == [(at(0), 1.0, 6.0), (at(1), None, 2.0)]
    with pytest.raises(ValueError):
        A.national_mean(w.select("city", "datetime"))
    weights = A.city_weights(spark.createDataFrame([("a", 30), ("b", 10)], "city string, population int"))
    got = A.weighted_mean(w, weights, ["t", "c"]).orderBy("datetime").collect()
    assert [tuple(r) for r in got] == [(at(0), 1.0, 5.0), (at(1), None, 2.0)]


def test_combine_first(spark):
    new = spark.createDataFrame([(1, 10.0), (2, None), (4, None)], "k int, v double")
    old = spark.createDataFrame([(2, 20.0), (3, 30.0), (1, 1.0)], "k int, v double")
    assert sorted(map(tuple, A.combine_first(new, old, "k", ["v"]).collect())) == [(1, 10.0), (2, 20.0), (3, 30.0), (4, None)]


def test_nearest_join_equals_brute_force(spark):
    rng = random.Random(5)
    known = sorted(rng.sample(range(0, 40_000), 40))
    wanted = [rng.randint(-500, 40_500) for _ in range(400)] + [known[3]] * 200 + [(known[5] + known[6]) // 2 if (known[5] + known[6]) % 2 == 0 else known[0]]
    lookup = spark.createDataFrame([(START + timedelta(minutes=m), float(m)) for m in known], "known timestamp_ntz, v double")
    targets = spark.createDataFrame([(i, START + timedelta(minutes=m)) for i, m in enumerate(wanted)] + [(9999, None)], "i int, t timestamp_ntz")
    got = {r["i"]: r["v"] for r in A.nearest_join(targets, lookup, "t", "known", pieces=8).collect()}
    assert len(got) == len(wanted) + 1 and got[9999] is None
    for i, m in enumerate(wanted):
        assert got[i] == float(min(known, key=lambda k: (abs(k - m), k)))


def test_nearest_row_tie_and_latest(spark):
    df = spark.createDataFrame([(at(2), 2), (at(1), 1), (at(5), 5)], "datetime timestamp_ntz, v int")
    assert A.nearest_row(df, "datetime", "2024-01-01 01:30:00").first()["v"] == 1
    assert A.latest_row(df, "datetime").first()["v"] == 5
    assert A.retain(df, "datetime", "2024-01-11 01:00:00").count() == 2


def test_contract(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"b": 5.0, "a": 4.0, "z": 0.0}), (3, {"a": 7.0})], "i int, f map<string,double>")
    checked = {r["i"]: (r["missing_features"], r["extra_features"]) for r in N.contract_of_maps(df, "f", ["b", "a"]).collect()}
    assert checked == {1: ([], []), 2: ([], ["z"]), 3: (["b"], [])}
    wide = N.features_from_maps(df, "f", ["b", "a"], keep=["i"])
    assert wide.columns == ["i", "b", "a"] and sorted(map(tuple, wide.collect())) == [(1, 2.0, 1.0), (2, 5.0, 4.0)]
    with pytest.raises(N.MissingFeatures) as problem:
        N.check_contract(wide, ["b", "c"])
    assert problem.value.missing == ["c"] and problem.value.extra == ["i", "a"]
    assert N.check_contract(wide, ["a", "b"]) == ["i"]
    assert N.ordered_features(wide, ["a", "b"]).columns == ["a", "b"]
    assert len(N.FEATURES) == 22


def history(spark, n):
    return spark.createDataFrame([(START + timedelta(minutes=30 * i), 100.0 + i % 7) for i in range(n)], "datetime timestamp_ntz, load_mw double")


def weather(spark, hours):
    return spark.createDataFrame([(at(h), *[float(h + k) for k in range(5)]) for h in hours], "datetime timestamp_ntz, " + ", ".join(f"{v} double" for v in N.WEATHER))


def test_feature_table_values(spark):
    n = 400
    got = N.feature_table(history(spark, n), weather(spark, range(0, 150))).orderBy("datetime").toPandas()
    assert list(got.columns) == ["datetime", "load_mw", *N.FEATURES]
    assert len(got) == 300
    values = pd.Series([100.0 + i % 7 for i in range(n)])
    np.testing.assert_allclose(got["load_lag_48h"].astype(float), values.shift(96)[:300], equal_nan=True)
    np.testing.assert_allclose(got["load_roll_std_24h"].astype(float), values.rolling(48).std()[:300], rtol=1e-8, equal_nan=True)
    row = got.iloc[37]
    assert (row["hour"], row["dayofweek"], row["is_weekend"], row["month"], row["dayofyear"]) == (18, 0, 0, 1, 1)
    assert row["hour_sin"] == pytest.approx(-1.0) and row["temperature_2m"] == 18.0


def test_live_features(spark):
    hist, w = history(spark, 400), weather(spark, range(0, 150))
    row = N.live_features(hist, w, "2024-01-03 10:20:00").first()
    table = N.feature_table(hist, weather(spark, range(0, 300))).orderBy(F.desc("datetime")).first()
    assert all(row[n] == pytest.approx(table[n]) for n in N.HISTORY)
    assert row["hour"] == 10 and row["temperature_2m"] == 58.0


def test_cold_start_and_short_history(spark):
    w = weather(spark, range(3))
    empty = N.live_features(history(spark, 1).limit(0), w, "2024-01-01 01:00:00").first()
    assert all(empty[n] == 0.0 for n in N.HISTORY)
    short = N.live_features(history(spark, 50), w, "2024-01-01 01:00:00").first()
    assert short["load_lag_168h"] is None and short["load_lag_24h"] is not None and short["load_roll_mean_168h"] is None


def test_daily_metrics(spark):
    df = spark.createDataFrame([(at(0), 100.0, 110.0), (at(1), 200.0, 180.0), (at(2), 0.0, 5.0), (at(30), None, 1.0), (at(31), 50.0, 50.0)], "t timestamp_ntz, y double, f double")
    got = [tuple(r) for r in daily_metrics(df, "t", "y", "f").orderBy("day").collect()]
    assert got[0] == (START, pytest.approx(10.0), pytest.approx(35 / 3), pytest.approx((525 / 3) ** 0.5), 3)
    assert got[1] == (at(24), 0.0, 0.0, 0.0, 1)


@pytest.mark.parametrize("horizon", [24, 12, 36])
def test_walk_forward(spark, horizon):
    df = spark.createDataFrame([(at(3 * i),) for i in range(40)], "t timestamp_ntz")
    folds = walk_forward_folds(df, "t", horizon).orderBy("fold").collect()
    assert [f["fold"] for f in folds] == [at(24 * d) for d in range(1, 5)]
    for fold in folds:
        rows = fold_rows(df, "t", fold["fold"].isoformat(sep=" "), horizon)
        counts = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
        assert counts == {"train": fold["train_rows"], "test": fold["test_rows"]}
    roles = walk_forward_roles(df, "t", horizon).collect()
    assert all(r["first_train_fold"] > r["t"] for r in roles)


def test_residual_and_extremes(spark):
    load = spark.createDataFrame([(at(0), 10.0), (at(1), 20.0), (at(2), None)], "datetime timestamp_ntz, load_mw double")
    mix = spark.createDataFrame([(at(0), "WIND", 1.0), (at(0), "WIND", 2.0), (at(0), "GAS", 9.0), (at(2), "SOLAR", 1.0)], "datetime timestamp_ntz, production_type string, value_mw double")
    got = [(r["wind_mw"], r["solar_mw"], r["residual_mw"]) for r in residual_load(load, mix).orderBy("datetime").collect()]
    assert got == [(3.0, 0.0, 7.0), (None, None, None), (0.0, 1.0, None)]
    assert [r["is_extreme"] for r in flag_extreme(load, share=0.5).orderBy("datetime").collect()] == [0, 1, None]
    assert flag_extreme(load.where("load_mw > 99")).count() == 0
    odd = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),)], "load_mw double")
    assert [r["is_extreme"] for r in flag_extreme(odd, share=0.5).collect()] == [0, 1, None, None]


def test_null_series_are_series_too(spark):
    rows = [(None, at(0), 1.0), (None, at(2), 3.0), ("a", at(0), 10.0), ("a", at(1), 20.0)]
    df = spark.createDataFrame(rows, "k string, datetime timestamp_ntz, load_mw double")
    grid = A.resample_mean(df, keys=["k"]).collect()
    assert {(r["k"], r["datetime"]): r["load_mw"] for r in grid} == {
        (None, at(0)): 1.0, (None, at(1)): None, (None, at(2)): 3.0, ("a", at(0)): 10.0, ("a", at(1)): 20.0,
    }
    filled = {(r["k"], r["datetime"]): r["load_mw"] for r in fill_gaps(df, keys=["k"], pieces=2).collect()}
    assert filled[(None, at(1))] == 2.0 and len(filled) == 5


def test_gap_fill(spark):
    known = {0: 1.0, 1: 2.0, 4: 8.0, 168: 100.0, 169: None, 175: 50.0, 180: 60.0}
    df = spark.createDataFrame([(at(h), v) for h, v in known.items()], "datetime timestamp_ntz, load_mw double")
    got = {r["datetime"]: (r["load_mw"], r["filled_from"]) for r in fill_gaps(df, pieces=5).collect()}
    assert len(got) == 181
    assert got[at(2)] == (4.0, "interpolated") and got[at(3)] == (6.0, "interpolated")
    assert got[at(169)] == (2.0, "last_week") and got[at(172)] == (8.0, "last_week")
    assert got[at(170)] == (4.0, "interpolated") and got[at(178)] == (pytest.approx(56.0), "interpolated")
    assert got[at(175)] == (50.0, "observed")
