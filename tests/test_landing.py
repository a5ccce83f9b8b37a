"""Year batches, and JSON documents cut into splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clinigrid.sources import files, json_splits, landing

SCHEMA = "clues int, total double, year int"


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(i, float(i), 2015 + i % 4) for i in range(400)] + [(1, 2.0, None)], SCHEMA)


def test_a_batch_is_replaced_without_others(spark, rows, table, tmp_path):
    path = f"{tmp_path}/landed"
    landing.land_years(table, path)
    first = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    landing.land_years(table.where("year = 2016").withColumn("total", F.col("total") + 1), path)
    kept = {p for p in tmp_path.rglob("*.parquet")} & set(first)
    assert kept and not any("year=2016" in str(p) for p in kept)
    assert {p.parent.name for p in kept} == {"year=2015", "year=2017", "year=2018", "year=__HIVE_DEFAULT_PARTITION__"}
    expected = table.withColumn("total", F.when(F.col("year") == 2016, F.col("total") + 1).otherwise(F.col("total")))
    assert rows(landing.read_years(spark, path, SCHEMA).select("clues", "total", "year")) == rows(expected)


def test_landing_again_changes_nothing(spark, rows, table, tmp_path):
    path = f"{tmp_path}/landed"
    landing.land_years(table, path)
    before = rows(landing.read_years(spark, path, SCHEMA))
    landing.land_years(table, path)
    assert rows(landing.read_years(spark, path, SCHEMA)) == before


def test_only_the_years_asked_for_are_opened(spark, table, tmp_path):
    path = f"{tmp_path}/landed"
    landing.land_years(table, path)
    found = landing.read_years(spark, path, SCHEMA, [2015, 2017])
    assert found.count() == 200
    opened = {r["f"].split("/")[-2] for r in found.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert opened == {"year=2015", "year=2017"}
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString() or "year" in str(found._jdf.queryExecution())


RECORD = "`Clave Única` string, n bigint, nested struct<a: string, b: array<struct<c: bigint>>>, note string"
ODD = ['plain', 'with } brace', '{"not": [a record]}', 'quote " and \\ slash', '\\"}', '"', "}]},{", "line\nbreak", "é😀", ""]


def document(rng, n, **more):
    data = [{
        "Clave Única": rng.choice(ODD), "n": i,
        "nested": rng.choice([None, {"a": rng.choice(ODD), "b": [{"c": k} for k in range(rng.randint(0, 3))]}]),
        "note": rng.choice(ODD),
    } for i in range(n)]
    return {**more.get("before", {}), "data": data, **more.get("after", {})}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split_bytes", [64, 300, 1 << 20])
def test_splits_give_the_rows_of_the_whole_document(spark, rows, tmp_path, indent, split_bytes):
    rng = random.Random(split_bytes)
    documents = [
        document(rng, 60), document(rng, 0), document(rng, 1),
        document(rng, 30, before={"x": 1, "text": "a [ in { it"}, after={"source": [{"n": -1, "note": "no record"}], "y": None}),
        document(rng, 20, before={"source": [{"n": -2, "note": "none"}, {"n": -3}]}),
    ]
    for i, d in enumerate(documents):
        (tmp_path / f"d{i}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=bool(i % 2)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = json_splits.fragments(spark, str(tmp_path)).select("file", "split").distinct().count()
        assert parts > 20 if split_bytes == 64 else parts >= 4
        got = json_splits.read_json_records_split(spark, str(tmp_path), RECORD)
        assert got.columns == ["clave_unica", "n", "nested", "note"]
        found = rows(got)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert found == rows(files.read_json_records(spark, str(tmp_path), RECORD)) and len(found) == 111
