"""Fold metrics from sums against fitting every fold anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinigrid.operators import linear_cv
from clinigrid.operators.forest import fold_number, split_flag


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 50.0, 0.01]
    y = 2 + x @ [1.5, -0.02, 30.0] + rng.normal(size=400)
    data = [(f"{i}", "a" if i % 3 else "b", *map(float, row), 7.0, float(v)) for i, (row, v) in enumerate(zip(x, y))]
    data += [("none", "a", None, 1.0, 1.0, 7.0, 1.0), ("alone", "c", 1.0, 1.0, 1.0, 7.0, 1.0)]
    return spark.createDataFrame(data, "k string, g string, x1 double, x2 double, x3 double, same double, y double")


def test_equals_fitting_every_fold(table):
    features = ["x1", "x2", "x3", "same"]
    got = linear_cv.cv_metrics_linear(table, "y", features, ["k"], "g", folds=4).collect()
    rows = table.dropna().withColumns({"train": split_flag(["k"]), "fold": fold_number(["k"], 4)}).toPandas()
    assert {r["g"] for r in got} == {"a", "b"}
    for group in "ab":
        mine = rows[rows.g == group]
        train, test = mine[mine.train], mine[~mine.train]

        def fit(data, penalty):
            x, y = data[["x1", "x2", "x3"]].to_numpy(), data["y"].to_numpy()
            scale = x.std(axis=0)
            z = (x - x.mean(axis=0)) / scale
            slope = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(3), z.T @ (y - y.mean()) / len(z)) / scale
            return lambda d: y.mean() + (d[["x1", "x2", "x3"]].to_numpy() - x.mean(axis=0)) @ slope

        def score(model, data):
            p, y = model(data), data["y"].to_numpy()
            return np.sqrt(np.mean((y - p) ** 2)), np.corrcoef(p, y)[0, 1] ** 2

        means = {}
        for penalty in linear_cv.PENALTIES:
            each = [score(fit(train[train.fold != f], penalty), train[train.fold == f]) for f in range(4)]
            for at, metric in enumerate(("rmse", "rsq")):
                values = np.array([e[at] for e in each])
                row = next(r for r in got if (r["g"], r["set"], r["penalty"], r["metric"]) == (group, "folds", penalty, metric))
                assert row["mean"] == pytest.approx(values.mean()) and row["n"] == 4
                assert row["std_err"] == pytest.approx(values.std(ddof=1) / 2)
                means[penalty, metric] = values.mean()
        best = max(linear_cv.PENALTIES, key=lambda p: means[p, "rsq"])
        told = {r["metric"]: r for r in got if r["g"] == group and r["set"] == "test"}
        expected = score(fit(train, best), test)
        assert {r["penalty"] for r in told.values()} == {best}
        assert (told["rmse"]["mean"], told["rsq"]["mean"]) == pytest.approx(expected)


def test_reads_its_rows_once(table):
    sums = linear_cv.fold_sums(table, "y", ["x1"], ["k"], "g")
    assert sums._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_constant_predictions_have_no_correlation(table):
    flat = table.withColumn("x1", F.lit(1.0))
    got = linear_cv.cv_metrics_linear(flat, "y", ["x1"], ["k"], "g").where("metric = 'rsq' and set = 'folds'").collect()
    assert got and all(r["mean"] is None and r["n"] == 0 for r in got)


def test_nothing(table):
    assert linear_cv.cv_metrics_linear(table.limit(0), "y", ["x1"], ["k"], "g").count() == 0
