"""Cross-validated linear models from one pass: sums of products per fold, complements for training.

A fold's training sums are the total less its own, and its errors follow from its sums as
well. So all folds and all penalties are scored from one aggregate over the rows, whose
result is a few numbers per group and fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.operators.forest import FOLDS, SEED, fold_number, split_flag, summarise_folds
from clinigrid.session import materialise

# Penalties tried.
PENALTIES = (0.0, 0.01, 0.1, 1.0, 10.0)
# The fold number that test rows have.
TEST = -1


def fold_sums(
    df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], by: str,
    folds: int = FOLDS, seed: int = SEED,
) -> DataFrame:
    """(by, fold, n, sums): the sums of all products of the constant, the features and the label.

    One row per group and fold, TEST for the rows held out for the end. ``sums`` is the
    upper triangle of the products row by row. Rows with a missing value are left out.
    """
    values = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in (*features, label)]]
    names = [f"v{i}" for i in range(len(values))]
    fold = F.when(split_flag(keys, seed=seed), fold_number(keys, folds, seed)).otherwise(TEST)
    rows = df.dropna("any", subset=[*features, label, by]).select(
        F.col(by), fold.alias("fold"), *[v.alias(n) for v, n in zip(values, names)]
    )
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(by, "fold").agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("sums"))


def _square(sums, width: int) -> np.ndarray:
    whole = np.zeros((width, width))
    whole[np.triu_indices(width)] = sums
    return whole + np.triu(whole, 1).T


def ridge(products: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients, constant first, from the products of (1, features, label).

    Features count by their standard deviations, and the penalty lies on slopes alone; a
    constant feature has none.
    """
    n, means = products[0, 0], products[0] / products[0, 0]
    centred = (products - np.outer(products[0], products[0]) / n)[1:, 1:] / n
    size = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0))
    size[size <= 1e-9 * np.abs(means[1:-1])] = np.inf
    inner = centred[:-1, :-1] / np.outer(size, size) + penalty * np.eye(len(size))
    slopes = np.linalg.lstsq(inner, centred[:-1, -1] / size, rcond=None)[0] / size
    return np.concatenate([[means[-1] - means[1:-1] @ slopes], slopes])


def errors(products: np.ndarray, beta: np.ndarray) -> tuple[float, float | None]:
    """Root mean squared error and squared correlation of a model on rows of given products."""
    n = products[0, 0]
    fitted = np.concatenate([beta, [0.0]])
    residual = np.concatenate([-beta, [1.0]])
    rmse = float(np.sqrt(max(0.0, residual @ products @ residual) / n))
    label = np.zeros(len(products))
    label[-1] = 1.0

    def spread(a, b):
        return a @ products @ b / n - (products[0] @ a) * (products[0] @ b) / n**2

    both = spread(fitted, fitted) * spread(label, label)
    # Rounding noise is no spread: such predictions or labels are constant.
    scale = (fitted @ products @ fitted / n) * (label @ products @ label / n)
    return rmse, float(spread(fitted, label) ** 2 / both) if n > 1 and both > 1e-12 * scale else None


def cv_metrics_linear(
    df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str], by: str,
    penalties: Sequence[float] = PENALTIES, folds: int = FOLDS, seed: int = SEED,
) -> DataFrame:
    """(by, set, penalty, metric, mean, n, std_err) of ridge regressions, per group of ``by``.

    ``folds``: every penalty over the folds; ``test``: the penalty of the largest mean
    squared correlation, the first of equals, fitted on all training rows and scored on
    the test rows. A group of fewer than two folds has no rows.
    """
    width = len(features) + 2
    kind = df.schema[by].dataType.simpleString()
    sums = materialise(fold_sums(df, label, features, keys, by, folds, seed), "fold-sums")

    # A group is one row per fold.
    def scored(key, frame):
        import pandas as pd

        parts = {f: _square(s, width) for f, s in zip(frame["fold"], frame["sums"])}
        total = sum((p for f, p in parts.items() if f != TEST), np.zeros((width, width)))
        held = sorted(f for f in parts if f != TEST)
        out = []
        for number, penalty in enumerate(penalties):
            for fold in held if len(held) > 1 else ():
                beta = ridge(total - parts[fold], penalty)
                out.append((key[0], fold, number, penalty, *errors(parts[fold], beta)))
            if len(held) > 1 and TEST in parts:
                out.append((key[0], TEST, number, penalty, *errors(parts[TEST], ridge(total, penalty))))
        return pd.DataFrame(out, columns=["by", "fold", "number", "penalty", "rmse", "rsq"])

    told = sums.groupBy(by).applyInPandas(
        scored, "by " + kind + ", fold int, number int, penalty double, rmse double, rsq double"
    )
    # A missing number comes back as NaN from pandas.
    told = told.withColumn("rsq", F.when(~F.isnan("rsq"), F.col("rsq"))).withColumnRenamed("by", by)
    told = materialise(told.unpivot([by, "fold", "number", "penalty"], ["rmse", "rsq"], "metric", "estimate"), "scores")
    tuning = materialise(summarise_folds(told.where(F.col("fold") != TEST), [by, "number", "penalty"]), "tuning")
    rank = F.struct((-F.round(F.coalesce("mean", F.lit(-1.0)), 9)).alias("less"), "number")
    best = tuning.where("metric = 'rsq'").groupBy(by).agg(F.min(rank)["number"].alias("number"))
    test = told.where(F.col("fold") == TEST).join(best, [by, "number"]).select(
        by, "penalty", "metric", F.col("estimate").alias("mean"), F.lit("test").alias("set")
    )
    return tuning.select(by, "penalty", "metric", "mean", "n", "std_err", F.lit("folds").alias("set")).unionByName(
        test, allowMissingColumns=True
    )
