"""Training and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.functions.text import finite
from loadweave.operators.backtest import daily_metrics, pooled_metrics, walk_forward_folds
from loadweave.operators.features import FEATURES, TARGET, check_contract, contract_of_maps
from loadweave.session import scratch_path, scratch_root, stage

ROWS_PER_TASK = 50_000


@dataclass(frozen=True)
class BoostingParams:
    """Declared training parameters. Columns are sampled per split, not per tree."""

    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


def boosted_trees(features: Sequence[str] = FEATURES, label: str = TARGET, params: BoostingParams | None = None) -> Pipeline:
    """Assembles the filled features (see train) and boosts trees on them."""
    p = params or BoostingParams()
    assembler = VectorAssembler(inputCols=[f"_filled_{n}" for n in features], outputCol="_features")
    trees = GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol="prediction",
        maxIter=p.trees,
        maxDepth=p.depth,
        stepSize=p.rate,
        subsamplingRate=p.row_share,
        featureSubsetStrategy=str(p.column_share),
        seed=p.seed,
        checkpointInterval=50,
    )
    return Pipeline(stages=[assembler, trees])


def train(
    df: DataFrame, features: Sequence[str] = FEATURES, label: str = TARGET, params: BoostingParams | None = None, stored: bool = False
) -> PipelineModel:
    """Fits on all rows with a label; ``stored`` rows are a stored table or a filter on one, and are not copied.

    A missing feature value counts as the mean of the training rows, 0.0 where
    they have none; the means are part of the model, so rows with missing
    values are scored in the same way.
    """
    check_contract(df, features)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # Boosting cuts the lineage of its intermediate errors here.
        context.setCheckpointDir(scratch_root(df.sparkSession))
    rows = df.select(*features, label).where(finite(label).isNotNull())
    rows = rows if stored else stage(rows, "training")
    facts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.avg(finite(name)).alias(name) for name in features]).first()
    filled = ", ".join(f"coalesce(nanvl(CAST(`{n}` AS DOUBLE), NULL), {facts[n] or 0.0!r}D) AS `_filled_{n}`" for n in features)
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    # Boosting is a long row of short jobs: as many tasks as the rows are worth.
    dealt = rows.coalesce(max(1, -(-facts["_rows"] // ROWS_PER_TASK)))
    return Pipeline(stages=[fill, *boosted_trees(features, label, params).getStages()]).fit(dealt)


def train_each(df: DataFrame, models: Sequence[tuple[Sequence[str], str]], params: BoostingParams | None = None) -> list[PipelineModel]:
    """One model per (features, label), fitted side by side: boosting is many short jobs that leave tasks free."""
    with ThreadPool(len(models)) as pool:
        return pool.starmap(inheritable_thread_target(df.sparkSession)(train), [(df, features, label, params) for features, label in models])


def missing_values(features: Sequence[str]) -> Column:
    """How many of a row's features have no value."""
    return sum((finite(n).isNull().cast("int") for n in features), F.lit(0))


def score(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds ``prediction`` to every row, and in ``filled`` how many of its features had no value."""
    check_contract(df, features)
    scored = model.transform(df.withColumn("filled", missing_values(features)))
    return scored.drop("_features", *[f"_filled_{n}" for n in features])


def score_requests(
    model: PipelineModel, requests: DataFrame, values: str = "features", features: Sequence[str] = FEATURES
) -> DataFrame:
    """Scores name-to-value maps, one request per row, none left out.

    Adds prediction, missing_features and extra_features; a request that lacks a
    feature, or has no value for it, keeps a null prediction.
    """
    given = requests.withColumn(values, F.map_filter(values, lambda _, v: v.isNotNull()))
    checked = contract_of_maps(given, values, features)
    wide = checked.select("*", *[F.col(values)[name].cast("double").alias(name) for name in features])
    scored = model.transform(wide).select(*checked.columns, "prediction")
    return scored.withColumn("prediction", F.when(F.size("missing_features") == 0, F.col("prediction")))


def walk_forward(
    rows: DataFrame,
    time: str,
    label: str,
    folds: Sequence[str] | None = None,
    features: Sequence[str] = FEATURES,
    horizon_hours: int = 24,
    params: BoostingParams | None = None,
    stride: int = 1,
    side_by_side: int = 8,
) -> DataFrame:
    """Forecasts of each fold by a model that knows only what lay before it: fold, target_time, actual, forecast.

    rows: features at ``time`` and the label ``horizon_hours`` later, stored once. A
    fold is two filters on them: it trains on the rows whose label lay before its
    start and forecasts the ``horizon_hours`` from its start on. Boosting is a long row
    of short jobs that leave tasks free, so ``side_by_side`` folds are fitted at a
    time, each in a scheduler pool of its own (they share tasks evenly where
    spark.scheduler.mode is FAIR). A fold without training rows is left out. Without
    ``folds``, all days that have earlier rows are folds, or every ``stride``-th.
    """
    spark = rows.sparkSession
    rows = stage(rows.withColumn("target_time", F.col(time) + F.make_interval(hours=F.lit(horizon_hours))), "backtest")
    if folds is None:
        # One row per day reaches the driver.
        days = walk_forward_folds(rows.where(F.col("target_time").isNotNull()), "target_time", horizon_hours).select("fold").sort("fold").collect()
        folds = [str(r.fold) for r in days][::stride]
    first = rows.where(finite(label).isNotNull()).agg(F.min("target_time")).first()[0]
    folds = [fold for fold in folds if first is not None and first < datetime.fromisoformat(fold)]
    if not folds:
        raise ValueError("no fold has rows to train on")
    out = scratch_path(spark, "folds")

    def forecast(numbered: tuple[int, str]) -> None:
        number, fold = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{number % side_by_side}")
        start = F.lit(fold).cast("timestamp_ntz")
        known = rows.where(F.col("target_time") < start)
        asked = rows.where((F.col("target_time") >= start) & (F.col("target_time") < start + F.make_interval(hours=F.lit(horizon_hours))))
        scored = score(train(known, features, label, params, stored=True), asked, features)
        scored.select(start.alias("fold"), "target_time", F.col(label).alias("actual"), F.col("prediction").alias("forecast")).write.parquet(f"{out}/number={number}")

    with ThreadPool(min(side_by_side, len(folds))) as pool:
        pool.map(inheritable_thread_target(spark)(forecast), enumerate(folds), chunksize=1)
    return spark.read.parquet(out).drop("number")


def backtest_report(forecasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daily report, and rmse, mae and mape over all pairs."""
    return daily_metrics(forecasts, "target_time", "actual", "forecast"), pooled_metrics(forecasts, "actual", "forecast")
