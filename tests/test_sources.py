import json

import pytest
from pyspark.sql import functions as F

from clinigrid.functions import drop_all_missing
from clinigrid.sources import files, schemas


def test_delimited_round_trip(spark, rows, tmp_path):
    ddl = "code string, n long, v double, gone string"
    df = spark.createDataFrame([("01", 1, 2.5, None), ("02", None, None, None)], ddl)
    files.write_delimited(df, f"{tmp_path}/t")
    text = "".join(f.read_text() for f in (tmp_path / "t").glob("*.csv"))
    assert "NA" in text and "\t" in text
    back = files.read_delimited(spark, f"{tmp_path}/t", ddl)
    assert rows(back) == rows(df)
    assert drop_all_missing(back).columns == ["code", "n", "v"]
    assert files.read_delimited(spark, f"{tmp_path}/t", ddl, columns=["code"]).columns == ["code"]


def test_delimited_columns_go_by_name(spark, rows, tmp_path):
    (tmp_path / "a.tsv").write_text("b\textra\ta\nx\t9\t01\n*\t9\t02\n")
    got = files.read_delimited(spark, str(tmp_path / "a.tsv"), "a string, b double")
    assert rows(got) == [("01", None), ("02", None)]
    with pytest.raises(ValueError, match="no column c"):
        files.read_delimited(spark, str(tmp_path / "a.tsv"), "a string, c int")


def test_delimited_folder_tells_files_apart(spark, rows, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.tsv").write_text(f"a\n{name}\n")
    got = files.read_delimited_folder(spark, f"{tmp_path}/*.tsv", "a string")
    assert rows(got) == [("one", "one.tsv"), ("two", "two.tsv")]


def test_column_choice_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "2")], "a string, b string, c string")
    files.write_delimited(df, f"{tmp_path}/t", sep=",")
    back = files.read_delimited(spark, f"{tmp_path}/t", df.schema, ["a", "c"], sep=",")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:string,c:string>" in plan


def test_json_records(spark, rows, tmp_path):
    for year, total in ((2016, 1.0), (2017, None)):
        record = {"State": "S", "Resources Categories": "Camas", "Year": year, "Total": total}
        (tmp_path / f"{year}.json").write_text(json.dumps({"data": [record], "source": ["x"]}, indent=1))
    got = files.read_json_records(
        spark, str(tmp_path), "State string, `Resources Categories` string, Year int, Total double"
    )
    assert got.columns == ["state", "resources_categories", "year", "total"]
    assert rows(got) == [("S", "Camas", 2016, 1.0), ("S", "Camas", 2017, None)]


def test_parse_json_records(spark, rows):
    df = spark.createDataFrame([('{"data":[{"a":1},{"a":2}]}',), ('{"data":[]}',)], "doc string")
    assert rows(files.parse_json_records(df, "doc", "a int")) == [(1,), (2,)]


def test_slices_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("x", 2016), ("y", 2017)], "a string, year int")
    files.write_sliced(df, f"{tmp_path}/s", ["year"])
    one = spark.read.schema("a string, year int").parquet(f"{tmp_path}/s").where(F.col("year") == 2017)
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()
    assert [r["a"] for r in one.collect()] == ["y"]


def test_table_stays_lazy(spark, rows):
    spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").createOrReplaceTempView("remote")
    assert rows(files.read_table(spark, "remote", ["a"]).where("a > 1")) == [(2,)]


def test_polygon_features(spark, rows, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"properties": {"CVEGEO": "01001"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"CVEGEO": "01002"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
    ]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, features)))
    got = files.read_polygon_features(spark, str(tmp_path / "f.json"), "CVEGEO")
    assert [f.name for f in got.schema] == ["geo_id", "part", "ring", "seq", "x", "y"]
    assert rows(got.groupBy("geo_id").agg(F.count("*"), F.max("part"), F.max("x"))) == [
        ("01001", 4, 0, 1.0), ("01002", 8, 1, 1.0),
    ]


def test_declared_schemas_parse():
    from pyspark.sql.types import StructType

    names = [n for n in vars(schemas) if n.isupper()]
    assert all(StructType.fromDDL(getattr(schemas, n)) for n in names)


def test_tables_that_cut_lineage_need_a_shared_folder():
    from types import SimpleNamespace

    from clinigrid.session import shared_folder

    def session(master, folder):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    assert shared_folder(session("spark://host:7077", "s3a://x/y/")) == "s3a://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077", None))
    local = session("local[2]", None)
    assert shared_folder(local) == shared_folder(local)
