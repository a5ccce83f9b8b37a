"""Seeded splits, cross-validated random forests, metrics and importances."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from clinigrid.operators.reshape import stack_named
from clinigrid.session import literal_table, materialise

# Forest size, columns tried per split, train share, folds and seed.
TREES = 2000
COLUMNS_PER_SPLIT = 10
TRAIN_PERCENT = 75
FOLDS = 10
SEED = 725
# Fixed value: smallest node of a regression forest. Depth is bound by what Spark accepts.
MIN_NODE = 5
MAX_DEPTH = 30
# In place of a grid setting's number: the forest as it is without one.
UNTUNED = -1


def _drawn(key: Sequence[str], seed: int, purpose: str):
    """A number below 2**32 for a row, from its key as text: the same in any partitioning or engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(f"{seed}{purpose}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def split_flag(key: Sequence[str], percent: int = TRAIN_PERCENT, seed: int = SEED):
    """True for the training share. Hashing the key makes it independent of partitions."""
    return _drawn(key, seed, "split") % 100 < percent


def fold_number(key: Sequence[str], folds: int = FOLDS, seed: int = SEED):
    return (_drawn(key, seed, "fold") % folds).cast("int")


def regular_grid(
    depths: Sequence[int] = (5, 10, 15, 20, 30),
    min_gains: Sequence[float] = (0.0, 1e-10, 1e-7, 1e-4, 1e-1),
) -> list[dict]:
    """Every combination of tree depth and smallest gain (what costs a split its place)."""
    return [{"maxDepth": d, "minInfoGain": g} for d in depths for g in min_gains]


@dataclass
class ForestSettings:
    label: str = "cfr"
    keys: Sequence[str] = ("CVEGEO", "ola")
    exclude: Sequence[str] = ("CVEGEO", "ola", "casos_totales", "defunciones")
    trees: int = TREES
    columns_per_split: int = COLUMNS_PER_SPLIT
    folds: int = FOLDS
    seed: int = SEED
    parallelism: int = 4
    grid: list[dict] = field(default_factory=regular_grid)


@dataclass
class ForestResult:
    model: Model
    tuning: DataFrame
    test: DataFrame
    importance: DataFrame
    elapsed_seconds: float
    untuned: DataFrame


def metrics(predictions: DataFrame, label: str) -> tuple[float | None, float | None]:
    """Root mean squared error and squared correlation, from one aggregate row."""
    error = F.sqrt(F.avg(F.pow(F.col(label) - F.col("prediction"), F.lit(2.0))))
    # Constant predictions have no correlation: missing, not an error.
    spread = F.stddev_pop(label) * F.stddev_pop("prediction")
    r = F.try_divide(F.covar_pop(label, "prediction"), spread)
    return tuple(predictions.agg(error, r * r).first())


def summarise_folds(per_fold: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, number of folds and standard error of each metric."""
    return per_fold.groupBy(*by, "metric").agg(
        F.avg("estimate").alias("mean"),
        F.count("estimate").alias("n"),
        F.try_divide(F.stddev_samp("estimate"), F.sqrt(F.count("estimate"))).alias("std_err"),
    )


def _forest(settings: ForestSettings, width: int) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol=settings.label, numTrees=settings.trees,
        featureSubsetStrategy=str(min(settings.columns_per_split, width)),
        minInstancesPerNode=MIN_NODE, maxDepth=MAX_DEPTH, seed=settings.seed,
    )


def fit_forest(table: DataFrame, settings: ForestSettings) -> ForestResult:
    """Score the untuned forest on folds of the training share, tune on them, refit the best setting, score the rest.

    Every fit and every prediction is a distributed job, and several fits run at once. A
    tuning model is dropped once it is scored; only metric rows and one importance per
    feature reach the driver.
    """
    started = time.perf_counter()
    spark = table.sparkSession
    names = [c for c in table.columns if c not in settings.exclude and c != settings.label]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    rows = materialise(
        assembler.transform(table.dropna("any")).select(
            F.col(settings.label).cast("double").alias(settings.label), "features",
            split_flag(settings.keys, seed=settings.seed).alias("train"),
            fold_number(settings.keys, settings.folds, settings.seed).alias("fold"),
        ),
        "forest",
    )
    train = rows.where("train")
    folds = [r["fold"] for r in train.select("fold").distinct().orderBy("fold").collect()]
    if len(folds) < 2:
        raise ValueError("too few complete rows to hold out a fold")
    forest = _forest(settings, len(names))

    def fit(data: DataFrame, number: int) -> Model:
        values = settings.grid[number] if number != UNTUNED else {}
        return forest.fit(data, {getattr(forest, k): v for k, v in values.items()})

    def held_out(fold: int, number: int) -> tuple:
        model = fit(train.where(F.col("fold") != fold), number)
        held = train.where(F.col("fold") == fold)
        return number, fold, *metrics(model.transform(held), settings.label)

    # The grid may hold what an untuned forest has: then that is fitted once.
    numbers = list(range(len(settings.grid)))
    untuned = next((n for n in numbers if settings.grid[n] == {"maxDepth": MAX_DEPTH, "minInfoGain": 0.0}), UNTUNED)
    if untuned == UNTUNED:
        numbers.append(UNTUNED)
    tasks = [
        inheritable_thread_target(spark)(partial(held_out, fold, number))
        for fold in folds for number in numbers
    ]
    with ThreadPool(settings.parallelism) as pool:
        scores = pool.map(lambda task: task(), tasks)
    per_fold = literal_table(spark, scores, "config int, fold int, rmse double, rsq double")
    scored_folds = summarise_folds(
        per_fold.unpivot(["config", "fold"], ["rmse", "rsq"], "metric", "estimate"), ["config"]
    )
    tuning = scored_folds.where(F.col("config") != UNTUNED)
    best = (
        tuning.where(F.col("metric") == "rsq")
        .orderBy(F.desc_nulls_last("mean"), "config").first()
    )
    model = fit(train, best["config"])
    scored = metrics(model.transform(rows.where(~F.col("train"))), settings.label)
    test = literal_table(
        spark, list(zip(("rmse", "rsq"), scored)), "metric string, estimate double"
    )
    importance = literal_table(
        spark, [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())],
        "variable string, importance double",
    ).orderBy(F.desc_nulls_last("importance"), "variable")
    grid = literal_table(
        spark,
        [(i, c["maxDepth"], float(c["minInfoGain"])) for i, c in enumerate(settings.grid)],
        "config int, max_depth int, min_info_gain double",
    )
    return ForestResult(
        model, tuning.join(F.broadcast(grid), "config"), test, importance,
        time.perf_counter() - started, scored_folds.where(F.col("config") == untuned).drop("config"),
    )


def fit_scenarios(
    table: DataFrame, scenarios: Mapping[str, Sequence[str]], settings: ForestSettings
) -> dict[str, ForestResult]:
    """One tuned forest per scenario of waves, one scenario at a time, so that its seconds are its own."""
    return {
        name: fit_forest(table.where(F.col("ola").isin(*olas)), settings)
        for name, olas in scenarios.items()
    }


def scenario_metrics(results: Mapping[str, ForestResult]) -> DataFrame:
    """Tuning and test metrics of all scenarios, with the seconds each one took."""
    return stack_named(
        {
            name: r.tuning.withColumn("set", F.lit("folds"))
            .unionByName(
                r.test.select("metric", F.col("estimate").alias("mean")).withColumn("set", F.lit("test")),
                allowMissingColumns=True,
            )
            .withColumn("elapsed_seconds", F.lit(r.elapsed_seconds))
            for name, r in results.items()
        },
        "scenario",
    )


def scenario_untuned(results: Mapping[str, ForestResult]) -> DataFrame:
    """Fold metrics of the untuned forest of all scenarios."""
    return stack_named(
        {
            name: r.untuned.withColumn("set", F.lit("untuned")).withColumn("elapsed_seconds", F.lit(r.elapsed_seconds))
            for name, r in results.items()
        },
        "scenario",
    )


def scenario_importance(results: Mapping[str, ForestResult]) -> DataFrame:
    return stack_named({name: r.importance for name, r in results.items()}, "scenario")
