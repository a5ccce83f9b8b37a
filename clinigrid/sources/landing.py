"""Batches by year, landed side by side: one batch is replaced or read without touching others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A year's rows are written by so many tasks, so that one large year is not one task.
FILES_A_YEAR = 8


def land_years(df: DataFrame, path: str, year: str = "year", files: int = FILES_A_YEAR) -> None:
    """Write ``df`` under ``path``, one folder a year; years that are not in ``df`` stay as they are.

    Landing the same batch again leaves the same rows. A missing year has a folder of its own.
    """
    spread = F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(files))
    (
        df.repartition(F.col(year), spread).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(year).parquet(path)
    )


def read_years(spark: SparkSession, path: str, schema, years: Sequence[int] | None = None, year: str = "year") -> DataFrame:
    """Landed rows of all years, or of those asked for, whose folders alone are opened."""
    df = spark.read.schema(schema).parquet(path)
    return df if years is None else df.where(F.col(year).isin(*years))
