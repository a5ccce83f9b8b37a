"""Results of scenario forests, kept as tables under one folder and read again.

A run is known by the rows it learned from and by its settings. Its manifest is written
last, so a folder without one is no run and is written over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinigrid.operators.forest import ForestSettings
from clinigrid.operators.forest_growth import Tuned, metric_rows
from clinigrid.session import literal_table, path_exists, shared_folder


@dataclass
class KeptRun:
    """``manifest`` has one row: run, trees, folds, settings, elapsed_seconds."""

    manifest: DataFrame
    models: DataFrame
    metrics: DataFrame
    importance: DataFrame
    nodes: DataFrame


def run_path(table: DataFrame, settings: ForestSettings, name: str) -> str:
    """The folder of the run of these rows with these settings; reads ``table`` once."""
    found = table.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64(*[f"`{c}`" for c in sorted(table.columns)]).cast("decimal(38,0)"))
    ).first()
    spark = table.sparkSession
    known = spark.range(1).select(F.sha2(F.lit(f"{sorted(table.columns)}{settings}{tuple(found)}"), 256)).first()[0]
    return f"{shared_folder(spark)}/runs/{name}-{known[:32]}"


def keep_run(found: Tuned, settings: ForestSettings, path: str) -> None:
    growth = found.growth
    for table, part in (
        (metric_rows(found), "metrics"), (found.importance, "importance"), (growth.nodes, "nodes"), (growth.models, "models"),
    ):
        table.write.mode("overwrite").parquet(f"{path}/{part}")
    literal_table(
        growth.rows.sparkSession,
        [(path.rsplit("/", 1)[-1], settings.trees, settings.folds, len(settings.grid), found.elapsed_seconds)],
        "run string, trees int, folds int, settings int, elapsed_seconds double",
    ).write.mode("overwrite").parquet(f"{path}/manifest")


def is_kept(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/manifest/_SUCCESS")


def read_run(spark: SparkSession, path: str) -> KeptRun:
    return KeptRun(*[
        spark.read.parquet(f"{path}/{part}") for part in ("manifest", "models", "metrics", "importance", "nodes")
    ])
