"""One fit after another, by Spark's own forests."""

import random

import pytest

from clinigrid.operators import forest


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    data = [(f"{i:04}", ["03_ola_2", "04_interola_2", "05_ola_3", "06_interola_3"][i % 4], 1, 1, 3 * x, x)
            for i, x in enumerate(draw.random() for _ in range(400))]
    return spark.createDataFrame(
        data, "CVEGEO string, ola string, casos_totales int, defunciones int, cfr double, signal double")


def test_a_grid_with_the_untuned_setting_is_fitted_once(table):
    grid = [{"maxDepth": 2, "minInfoGain": 0.0}, {"maxDepth": 30, "minInfoGain": 0.0}]
    found = forest.fit_forest(table, forest.ForestSettings(trees=3, folds=2, grid=grid))
    deep = {r["metric"]: r["mean"] for r in found.tuning.where("config = 1").collect()}
    assert {r["metric"]: r["mean"] for r in found.untuned.collect()} == deep
    assert found.tuning.count() == 4
