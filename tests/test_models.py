import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinigrid.operators import forest, stats
from clinigrid.sources import files


@pytest.fixture(scope="module")
def planted(spark):
    """cfr follows ``signal``; the other features are noise."""
    draw = random.Random(8)
    data = []
    for i in range(400):
        signal, noise = draw.random(), [draw.random() for _ in range(3)]
        data.append((f"{i:05}", "03_ola_2" if i % 2 else "05_ola_3", 1, 1, 10 * signal + draw.gauss(0, 0.1), signal, *noise))
    return spark.createDataFrame(
        data, "CVEGEO string, ola string, casos_totales int, defunciones int, cfr double, "
        "signal double, n1 double, n2 double, n3 double",
    )


def test_split_does_not_depend_on_partitions(planted, rows):
    flag = forest.split_flag(["CVEGEO", "ola"])
    a = rows(planted.repartition(3).where(flag), "CVEGEO")
    assert a == rows(planted.repartition(11).where(flag), "CVEGEO")
    assert 0.65 < len(a) / planted.count() < 0.85


def test_folds_are_balanced(spark):
    counts = spark.range(20_000).groupBy(forest.fold_number(["id"]).alias("f")).count().collect()
    assert sorted(r["f"] for r in counts) == list(range(10))
    assert all(1800 < r["count"] < 2200 for r in counts)


def test_metrics_are_squared_correlation(spark):
    draw = np.random.default_rng(9)
    y = draw.normal(size=200)
    p = 3 * y + 5 + draw.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "cfr double, prediction double")
    rmse, rsq = forest.metrics(df, "cfr")
    assert rsq == pytest.approx(np.corrcoef(y, p)[0, 1] ** 2)
    assert rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert forest.metrics(df.withColumn("prediction", F.lit(1.0)), "cfr")[1] is None


def test_regular_grid():
    assert len(forest.regular_grid()) == 25


@pytest.fixture(scope="module")
def fitted(planted):
    settings = forest.ForestSettings(trees=10, folds=3, grid=forest.regular_grid((1, 6), (0.0,)))
    return forest.fit_scenarios(planted, {"A": ("03_ola_2",), "B": ("05_ola_3",)}, settings)


def test_forest_finds_the_signal(fitted):
    importance = forest.scenario_importance(fitted)
    first = importance.orderBy(F.desc("importance")).limit(2).collect()
    assert {(r["scenario"], r["variable"]) for r in first} == {("A", "signal"), ("B", "signal")}
    scores = forest.scenario_metrics(fitted).collect()
    deep = next(r for r in scores if r["scenario"] == "A" and r["max_depth"] == 6 and r["metric"] == "rsq")
    assert deep["mean"] > 0.9 and deep["n"] == 3 and deep["std_err"] > 0
    assert {r["set"] for r in scores} == {"folds", "test"}
    assert fitted["A"].model.getMaxDepth() == 6
    assert all(r.elapsed_seconds > 0 for r in fitted.values())


def test_models_are_saved(spark, fitted, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel

    files.write_models(fitted, f"{tmp_path}/results")
    assert RandomForestRegressionModel.load(f"{tmp_path}/results/model/A").getNumTrees == 10
    assert spark.read.parquet(f"{tmp_path}/results/importance").count() == 8


def test_loglog_regression(spark):
    data = [("w", 10.0**x, 10.0 ** (2 * x + 1)) for x in (0.1, 0.5, 1.0, 2.0)] + [("w", 0.0, 1.0), ("w", 1.0, None)]
    got = stats.loglog_regression(spark.createDataFrame(data, "ola string, x double, y double"), "x", "y", "ola").first()
    assert (got["n"], got["slope"], got["intercept"], got["r2"]) == pytest.approx((4, 2, 1, 1))


def test_glm_against_normal_equations(spark):
    draw = np.random.default_rng(10)
    levels = ["a", "b", "c"]
    data = [(float(x), levels[i % 3], float(2 + 3 * x - 1.5 * (i % 3 == 1) + 4 * (i % 3 == 2) + e))
            for i, (x, e) in enumerate(zip(draw.normal(size=300), draw.normal(size=300)))]
    df = spark.createDataFrame([*data, (None, "a", 1.0)], "x double, ola string, y double")
    got = {r["term"]: r for r in stats.glm_coefficients(df, "y ~ x + ola").collect()}
    assert sorted(got) == ["(Intercept)", "ola_b", "ola_c", "x"]
    design = np.array([[1, x, o == "b", o == "c"] for x, o, _ in data], dtype=float)
    y = np.array([v for *_, v in data])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (len(y) - 4))
    for i, term in enumerate(["(Intercept)", "x", "ola_b", "ola_c"]):
        assert got[term]["estimate"] == pytest.approx(beta[i])
        assert got[term]["std_error"] == pytest.approx(error[i])
        assert got[term]["statistic"] == pytest.approx(beta[i] / error[i])
    assert got["x"]["p_value"] < 1e-6
