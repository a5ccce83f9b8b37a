"""Regressions that describe how rates depend on resources."""

from __future__ import annotations

import re

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinigrid.session import literal_table, materialise


def loglog_regression(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Simple regression of log10 y on log10 x per group, over rows where both are positive."""
    lx, ly = F.log10(x), F.log10(y)
    return (
        df.where((F.col(x) > 0) & (F.col(y) > 0))
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope(ly, lx).alias("slope"),
            F.regr_intercept(ly, lx).alias("intercept"),
            F.regr_r2(ly, lx).alias("r2"),
        )
    )


def glm_coefficients(df: DataFrame, formula: str) -> DataFrame:
    """Gaussian linear model as a coefficient table, smallest p-value first.

    Text columns become factors whose first level, in alphabetical order, is the baseline.
    Rows with a missing value are left out. The fit reads its rows several times, so they
    are written first. Only one row per coefficient reaches the driver.
    """
    used = df.columns if "." in formula.split() else [
        c for c in df.columns if re.search(rf"\b{re.escape(c)}\b", formula)
    ]
    df = materialise(df.select(*used).dropna("any"), "glm")
    encoder = RFormula(
        formula=formula, featuresCol="_features", labelCol="_label",
        stringIndexerOrderType="alphabetDesc",
    ).fit(df)
    rows = encoder.transform(df).select("_features", "_label")
    model = GeneralizedLinearRegression(
        featuresCol="_features", labelCol="_label", family="gaussian"
    ).fit(rows)
    attributes = rows.schema["_features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    terms = [names[i] for i in range(len(names))] + ["(Intercept)"]
    summary = model.summary
    table = list(zip(
        terms,
        [float(c) for c in model.coefficients] + [float(model.intercept)],
        map(float, summary.coefficientStandardErrors),
        map(float, summary.tValues),
        map(float, summary.pValues),
    ))
    return literal_table(
        df.sparkSession, table,
        "term string, estimate double, std_error double, statistic double, p_value double"
    ).orderBy(F.asc_nulls_last("p_value"))
