"""Readers and writers: delimited text, JSON record documents, polygons, tables, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinigrid.functions import clean_names
from clinigrid.operators.forest import ForestResult, scenario_importance, scenario_metrics

MISSING = "NA"


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType,
    columns: Sequence[str] | None = None, sep: str = "\t", with_file: bool = False,
) -> DataFrame:
    """Delimited text with a header, matched to the schema by name.

    The file may hold more columns, in any order; only those asked for are parsed. Types
    come from the schema, never from the data; text that does not fit its type is missing.
    ``with_file`` adds the name of the file each row came from.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = [f for f in fields if columns is None or f.name in columns]
    text = (
        spark.read.option("sep", sep).option("header", True).option("nullValue", MISSING)
        .option("inferSchema", False).option("enforceSchema", False).csv(path)
    )
    absent = [f.name for f in wanted if f.name not in text.columns]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted]
    source = [F.col("_metadata.file_name").alias("file_name")] if with_file else []
    return text.select(*typed, *source)


def read_delimited_folder(
    spark: SparkSession, pattern: str, schema: str | T.StructType, sep: str = "\t"
) -> DataFrame:
    """All files of a folder as one table, with the file each row came from."""
    return read_delimited(spark, pattern, schema, sep=sep, with_file=True)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "error") -> None:
    (
        df.write.mode(mode).option("sep", sep).option("header", True)
        .option("nullValue", MISSING).csv(path)
    )


def write_sliced(df: DataFrame, path: str, slices: Sequence[str], mode: str = "error") -> None:
    """One folder per value of the slice columns; later scans read only the slices they need."""
    df.write.mode(mode).partitionBy(*slices).parquet(path)


def record_schema(record: str | T.StructType) -> T.StructType:
    fields = T.StructType.fromDDL(record) if isinstance(record, str) else record
    return T.StructType([T.StructField("data", T.ArrayType(fields))])


def read_json_records(
    spark: SparkSession, path: str | list[str], record: str | T.StructType, clean: bool = True
) -> DataFrame:
    """Rows of the ``data`` array of each JSON document.

    A document is read by one task, so extracts should be landed in slices (a document
    per year batch, as they are requested), not as one huge document.
    """
    df = spark.read.schema(record_schema(record)).option("multiLine", True).json(path)
    rows = df.select(F.inline("data"))
    return clean_names(rows) if clean else rows


def parse_json_records(df: DataFrame, column: str, record: str | T.StructType) -> DataFrame:
    """The same for documents held in a text column."""
    parsed = F.from_json(F.col(column), record_schema(record))
    return df.select(F.inline(parsed.getField("data")))


def read_table(
    spark: SparkSession, name: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A catalog table; stays lazy, so filters and columns chosen later reach its scan."""
    df = spark.table(name)
    return df.select(*columns) if columns else df


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_on: str, low: int, high: int,
    parts: int, **options: str,
) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric column at once."""
    reader = (
        spark.read.format("jdbc").option("url", url).option("dbtable", table)
        .option("partitionColumn", split_on).option("lowerBound", low)
        .option("upperBound", high).option("numPartitions", parts)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def read_polygon_features(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Vertex table of GeoJSON features, one feature per line.

    Handles ``Polygon`` and ``MultiPolygon``. ``key`` names the property that identifies
    the area.
    """
    rings = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    schema = T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType()),
        ])),
    ])
    df = spark.read.schema(schema).json(path)
    text = F.col("geometry.coordinates")
    single = F.array(F.from_json(text, rings))
    many = F.from_json(text, T.ArrayType(rings))
    parts = F.when(F.col("geometry.type") == "Polygon", single).otherwise(many)
    return (
        df.select(F.try_element_at("properties", F.lit(key)).alias("geo_id"), parts.alias("parts"))
        .select("geo_id", F.posexplode("parts").alias("part", "rings"))
        .select("geo_id", "part", F.posexplode("rings").alias("ring", "points"))
        .select("geo_id", "part", "ring", F.posexplode("points").alias("seq", "point"))
        .select("geo_id", "part", "ring", "seq",
                F.get("point", F.lit(0)).alias("x"), F.get("point", F.lit(1)).alias("y"))
    )


def write_models(results: dict[str, ForestResult], path: str) -> None:
    """Fitted forests, their metrics and importances, under one folder."""
    for name, result in results.items():
        result.model.write().save(f"{path}/model/{name}")
    scenario_metrics(results).write.parquet(f"{path}/metrics")
    scenario_importance(results).write.parquet(f"{path}/importance")
