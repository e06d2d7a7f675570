import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from loadweave.catalog import REGISTRY, feature_queries
from loadweave.operators.features import FEATURES, TARGET, WEATHER, feature_table, horizon_features, read_contract
from loadweave.plans.model import BoostingParams, backtest_report, boosted_trees, score, score_requests, train, walk_forward
from loadweave.sources.payloads import LOAD_PAYLOAD
from loadweave.streaming.live import follow_history, follow_predictions, last_batch, live_prediction, merge_batch, read_current

TABLES = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
NOW = "2024-01-21 00:00:00"


def document(first, last, shift=0.0, hole=None):
    values = []
    for i in range(first, last):
        t = START + timedelta(minutes=30 * i)
        values.append({"start_date": t.isoformat() + "Z", "end_date": (t + timedelta(minutes=30)).isoformat() + "Z",
                       "updated_date": "2024-02-01T00:00:00Z", "value": None if i == hole else i + shift})
    return {"short_term": [{"type": "REALISED", "values": values}]}


def land(folder, name, *documents):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d) for d in documents))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_split_batches_equal_one_batch(spark, tmp_path):
    parts = [document(0, 400), document(390, 700, 0.5, hole=395), document(690, 960)]
    for i, part in enumerate(parts):
        land(tmp_path / "many", f"{i}.json", part)
    run = lambda source, name, **k: follow_history(
        spark, str(tmp_path / source), str(tmp_path / name / "h"), str(tmp_path / name / "c"), lambda: NOW, **k
    ).awaitTermination()
    run("many", "stepwise", files_per_batch=1)
    got = rows(read_current(spark, str(tmp_path / "stepwise" / "h")))
    cutoff = datetime(2024, 1, 11)
    assert min(got)[0] == cutoff + timedelta(minutes=30) and len(got) == 479
    # All at once, then an empty batch of the same data: retention applies from the second version on.
    land(tmp_path / "one", "a.json", *parts)
    run("one", "single")
    single = {t: v for t, v in rows(read_current(spark, str(tmp_path / "single" / "h"))) if t > cutoff}
    assert {t: v for t, v in got if t > START + timedelta(minutes=30 * 700)} == {t: v for t, v in single.items() if t > START + timedelta(minutes=30 * 700)}
    assert set(single) == {t for t, _ in got}


def parsed(spark, *documents):
    text = spark.createDataFrame([(json.dumps(d),) for d in documents], "j string")
    return text.select(F.from_json("j", LOAD_PAYLOAD).alias("p")).select("p.*")


def test_merge_rules(spark, tmp_path):
    root = str(tmp_path / "h")
    assert last_batch(spark, root) == (None, None) and read_current(spark, root).count() == 0
    merge_batch(parsed(spark, {"short_term": []}), root, 0, NOW)
    assert last_batch(spark, root) == (None, None)
    merge_batch(parsed(spark, document(930, 940)), root, 1, NOW)
    merge_batch(parsed(spark, document(935, 945, 0.5, hole=937)), root, 2, NOW)
    index = lambda t: int((t - START).total_seconds() // 1800)
    wanted = [(i, float(i) if i < 935 or i == 937 else i + 0.5) for i in range(930, 945)]
    assert [(index(t), v) for t, v in rows(read_current(spark, root))] == wanted
    # The same batch again gives the same version; an empty one changes nothing.
    merge_batch(parsed(spark, document(935, 945, 0.5, hole=937)), root, 2, NOW)
    merge_batch(parsed(spark, {"short_term": None}), root, 3, NOW)
    assert last_batch(spark, root) == (2, datetime(2024, 1, 11))
    assert [(index(t), v) for t, v in rows(read_current(spark, root))] == wanted


def test_batch_numbers_may_start_anew(spark, tmp_path):
    """A stream with a new checkpoint counts its batches from 0; its data are merged all the same."""
    root = str(tmp_path / "h")
    merge_batch(parsed(spark, document(930, 940)), root, 0, NOW)
    merge_batch(parsed(spark, document(938, 950)), root, 0, NOW)
    assert [v for _, v in rows(read_current(spark, root))] == [float(i) for i in range(930, 950)]


@pytest.fixture(scope="module")
def training(spark):
    load = spark.range(900).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 30).cast("int"))).alias("datetime"),
        (F.lit(50_000.0) + (F.col("id") % 48) * 100 + F.col("id") % 5).alias("load_mw"),
    )
    weather = load.where(F.minute("datetime") == 0).select("datetime", *[(F.hour("datetime") + float(k)).alias(v) for k, v in enumerate(WEATHER)])
    return load.cache(), weather.cache(), feature_table(load, weather).cache()


def test_training_and_scoring(spark, training, tmp_path):
    _, _, table = training
    model = train(table, params=BoostingParams(trees=15, depth=4, rate=0.3))
    scored = score(model, table)
    lacking = table.count() - table.na.drop(subset=list(FEATURES)).count()
    assert scored.count() == table.count() and scored.where("prediction IS NULL").count() == 0
    assert scored.where("filled > 0").count() == lacking > 0
    spread, error = scored.agg(F.stddev("load_mw"), F.avg(F.abs(F.col("prediction") - F.col("load_mw")))).first()
    assert error < spread / 4
    path = str(tmp_path / "model")
    model.write().save(path)
    again = score(PipelineModel.load(path), table).agg(F.sum("prediction")).first()[0]
    assert again == pytest.approx(scored.agg(F.sum("prediction")).first()[0])
    with pytest.raises(ValueError, match="missing"):
        score(model, table.drop("hour"))


def test_a_day_ahead(spark, training):
    """Features at one time forecast the load a day later; features of a constant column or without values do no harm."""
    _, _, table = training
    ahead = horizon_features(table.withColumn("cloud_cover", F.lit(None).cast("double")), "datetime", TARGET, 24)
    assert ahead.where(F.col("target").isNull()).count() == 48
    model = train(ahead, label="target", params=BoostingParams(trees=15, depth=4, rate=0.3))
    scored = score(model, ahead)
    assert scored.count() == table.count()
    spread, error = scored.agg(F.stddev("target"), F.avg(F.abs(F.col("prediction") - F.col("target")))).first()
    assert error < spread / 4


def test_walk_forward_knows_only_the_past(spark, training):
    _, _, table = training
    ahead = horizon_features(table, "datetime", TARGET, 24)
    spoiled = ahead.withColumn("target", F.when(F.col("datetime") >= F.lit("2024-01-14").cast("timestamp_ntz"), F.lit(-1e9)).otherwise(F.col("target")))
    params = BoostingParams(trees=8, depth=4, rate=0.5)
    found = [walk_forward(rows, "datetime", "target", ["2023-12-01", "2024-01-12", "2024-01-15"], params=params) for rows in (ahead, spoiled)]
    answers = [sorted((r.target_time, r.forecast) for r in f.collect()) for f in found]
    assert answers[0] == answers[1]
    assert [r.n for r in found[0].groupBy("fold").agg(F.count("*").alias("n")).collect()] == [48, 48]
    daily, pooled = backtest_report(found[0])
    assert sorted(r.day for r in daily.collect()) == [datetime(2024, 1, 12), datetime(2024, 1, 15)]
    total = pooled.first()
    assert total.n == 96 and total.mae <= total.rmse and 0 < total.mape < 100
    with pytest.raises(ValueError, match="fold"):
        walk_forward(ahead, "datetime", "target", ["2023-12-01"], params=params)


def test_walk_forward_takes_all_days(spark, training):
    """Without a list, every day with rows before it is a fold, or every stride-th; each is forecast whole."""
    _, _, table = training
    ahead = horizon_features(table.where(F.col("datetime") < F.lit("2024-01-06 12:00:00").cast("timestamp_ntz")), "datetime", TARGET, 24)
    ahead = ahead.where(F.col("target").isNotNull())
    params = BoostingParams(trees=1, depth=2)
    for stride, days in ((1, (3, 4, 5, 6)), (3, (3, 6))):
        found = walk_forward(ahead, "datetime", "target", params=params, stride=stride).groupBy("fold").agg(F.count("forecast").alias("n")).collect()
        assert {r.fold: r.n for r in found} == {datetime(2024, 1, d): 24 if d == 6 else 48 for d in days}


def test_short_history_is_answered(spark, training, tmp_path):
    _, weather, table = training
    model = train(table, params=BoostingParams(trees=2))
    root = str(tmp_path / "h")
    merge_batch(parsed(spark, document(0, 192)), root, 1, NOW)
    row = live_prediction(spark, root, weather, model, "2024-01-05 00:10:00").collect()
    assert len(row) == 1 and row[0].prediction is not None and row[0].filled > 0
    assert live_prediction(spark, str(tmp_path / "none"), weather, model, "2024-01-05 00:10:00").first().prediction is not None


def test_requests_are_all_answered(spark, training):
    _, _, table = training
    model = train(table, params=BoostingParams(trees=2))
    good = {name: 1.0 for name in FEATURES}
    maps = [(1, good), (2, {**good, "pressure": 5.0}), (3, {k: v for k, v in good.items() if k != "hour"}), (4, {**good, "month": None})]
    got = {r["i"]: r for r in score_requests(model, spark.createDataFrame(maps, "i int, features map<string,double>")).collect()}
    assert got[1]["prediction"] == got[2]["prediction"] is not None and got[2]["extra_features"] == ["pressure"]
    assert got[3]["prediction"] is None and got[3]["missing_features"] == ["hour"]
    assert got[4]["prediction"] is None and got[4]["missing_features"] == ["month"]


def test_contract_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"target": "load", "features": ["b", "a"]}, indent=1))
    assert read_contract(spark, str(tmp_path / "m.json")) == (["b", "a"], "load")
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(ValueError):
        read_contract(spark, str(tmp_path / "n.json"))


def test_declared_parameters():
    trees = boosted_trees().getStages()[1]
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getSubsamplingRate(), trees.getSeed()) == (500, 6, 0.05, 0.8, 42)
    assert trees.getFeatureSubsetStrategy() == "0.8" and trees.getLabelCol() == TARGET


def test_live_predictions_survive_a_bad_batch(spark, training, tmp_path, monkeypatch):
    load, weather, table = training
    model = train(table, params=BoostingParams(trees=2))
    land(tmp_path / "in", "0.json", document(0, 450))
    import loadweave.streaming.live as live

    merge = live.merge_batch

    def fail(*arguments):
        raise RuntimeError("unreadable")

    def run():
        follow_predictions(
            spark, str(tmp_path / "in"), str(tmp_path / "h"), str(tmp_path / "c"), lambda: weather, model, str(tmp_path / "out"), lambda: "2024-01-10 09:00:00", files_per_batch=1
        ).awaitTermination()

    run()
    land(tmp_path / "in", "1.json", document(450, 460))
    monkeypatch.setattr(live, "merge_batch", fail)
    with pytest.raises(Exception, match="unreadable"):
        run()
    out = spark.read.parquet(str(tmp_path / "out" / "batch=*"))
    assert out.count() == 2 and set(FEATURES) <= set(out.columns)
    assert {r["datetime"] for r in out.collect()} == {datetime(2024, 1, 10, 9)}
    assert read_current(spark, str(tmp_path / "h")).count() == 450
    monkeypatch.setattr(live, "merge_batch", merge)
    run()
    assert read_current(spark, str(tmp_path / "h")).count() == 460
    assert spark.read.parquet(str(tmp_path / "out" / "batch=*")).count() == 2


def test_a_batch_rewrites_only_its_days(spark, tmp_path):
    root = str(tmp_path / "h")
    merge_batch(parsed(spark, document(0, 240)), root, 1, "2024-01-06 00:00:00")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "h" / "rows").glob("day=*/*.parquet")}
    merge_batch(parsed(spark, document(238, 250, 0.5)), root, 2, "2024-01-06 05:00:00")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "h" / "rows").glob("day=*/*.parquet")}
    assert sorted({p.parent.name for p in before.keys() & after.keys()}) == [f"day=2024-01-0{d}" for d in (1, 2, 3, 4)]
    assert all(before[p] == after[p] for p in before.keys() & after.keys())
    got = rows(read_current(spark, root))
    assert [v for _, v in got] == [float(i) if i < 238 else i + 0.5 for i in range(250)]


def test_rows_leave_the_history(spark, tmp_path):
    root = str(tmp_path / "h")
    for batch in range(13):
        merge_batch(parsed(spark, document(48 * batch, 48 * batch + 50)), root, batch, (START + timedelta(days=batch)).isoformat())
    cutoff = START + timedelta(days=2)
    assert last_batch(spark, root) == (12, cutoff)
    assert rows(read_current(spark, root)) == [(t, float(i)) for i in range(48 * 12 + 50) if (t := START + timedelta(minutes=30 * i)) > cutoff]


def test_a_killed_batch_is_finished_by_its_restart(spark, tmp_path):
    """The stream dies after a touched day is gone and before it is written again; the restart brings all of it back."""
    import shutil

    import loadweave.streaming.live as live

    def run():
        follow_history(spark, str(tmp_path / "in"), str(tmp_path / "h"), str(tmp_path / "c"), lambda: "2024-01-06 05:00:00", files_per_batch=1).awaitTermination()

    land(tmp_path / "in", "0.json", document(0, 240))
    run()
    land(tmp_path / "in", "1.json", document(238, 250, 0.5))
    merge = live.merge_batch

    def die(*arguments):
        merge(*arguments)
        shutil.rmtree(tmp_path / "h" / "rows" / "day=2024-01-05")
        raise RuntimeError("killed")

    live.merge_batch = die
    try:
        with pytest.raises(Exception, match="killed"):
            run()
    finally:
        live.merge_batch = merge
    assert len(rows(read_current(spark, str(tmp_path / "h")))) < 240
    run()
    got = rows(read_current(spark, str(tmp_path / "h")))
    assert [v for _, v in got] == [float(i) if i < 238 else i + 0.5 for i in range(250)]


@pytest.mark.skipif(not Path(TABLES).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["train_and_score_load", "score_stored_model", "score_requests", "train_and_score_generation"])
def test_queries_run_their_model(spark, monkeypatch, name):
    """A model that fails stops the query; one without answers scores no row. Neither prediction can be null to the optimizer."""

    def use(value):
        model = PipelineModel([SQLTransformer(statement=f"SELECT *, {value} AS prediction FROM __THIS__")])
        monkeypatch.setattr(feature_queries, "stored_model", lambda *_: model)
        monkeypatch.setattr(feature_queries, "train_each", lambda *_: [model, model])
        result = REGISTRY[name].run(spark, TABLES)
        return [r[c] for r in result.collect() for c in result.columns if c.endswith("scored")]

    with pytest.raises(Exception, match="the model ran"):
        use("coalesce(CAST(raise_error('the model ran') AS DOUBLE), 0D)")
    assert not any(use("CAST('NaN' AS DOUBLE)"))
    assert any(use("1D"))


def test_request_maps_of_all_events(spark, tmp_path):
    """Maps of every kind of event, also without type or value, keys repeated, from a file of one split: none lost, spread over tasks."""
    kinds = ["view", "click", "error", "signup", "purchase", "other", None]
    events = [(i % 40, kinds[i % 7], None if i % 5 == 0 else i / 4) for i in range(70)]
    spark.createDataFrame(events, "event_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    dealt = feature_queries._feature_maps(spark, str(tmp_path), lambda e: feature_queries._spread(e, 10))
    lacking = {"error": {"cloud_cover"}, "signup": {"hour", "month", "load_lag_1h"}, None: {"cloud_cover", "hour", "month", "load_lag_1h"}}

    def request(kind, value):
        names = [(n, i) for i, n in enumerate(FEATURES) if n not in lacking.get(kind, ())] + [("pressure", 0)] * (kind == "view")
        return {n: None if value is None else value + i for n, i in names}

    flat = lambda pairs: sorted(repr((i, sorted(m.items()))) for i, m in pairs)
    wanted = flat((i, request(kind, value)) for i, kind, value in events)
    for maps in (dealt, feature_queries._feature_maps(spark, str(tmp_path))):
        assert flat((r.event_id, r.features) for r in maps.collect()) == wanted
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) <= 20
    none = feature_queries._feature_maps(spark, str(tmp_path), lambda e: feature_queries._spread(e.where("false"), 10))
    assert none.count() == 0
