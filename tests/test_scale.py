"""Plans: what reaches the scan, what is shuffled, and what happens to a hot key."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from clinigrid.operators import graph
from clinigrid.plans import bindings

SF_DIR = "/root/testdata/sf0.001"


def plan(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def small_partitions(spark):
    """Thresholds of adaptive execution at the size of test data, and no broadcasts."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


CHEAP = [
    "cfr_by_wave", "tests_per_capita", "facility_staff", "resources_by_area_institution",
    "resources_population", "capita_wide", "coverage_wide", "contiguity_queen", "contiguity_rook",
    "simple_graph", "neighbourhood_totals", "cosine_edges", "partition_quality", "bed_zscore",
    "units_by_state_institution", "resource_trend", "binscatter_by_institution", "cube_slice_union",
    "feature_table_v1",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_product_joins_and_no_python_in_plans(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_case_scan_is_narrow_and_filtered(spark):
    text = plan(queries()["cfr_by_wave"](spark, SF_DIR))
    orders = next(line for line in re.findall(r"FileScan parquet .*", text) if "orders.parquet" in line)
    assert "o_totalprice" not in orders and "o_orderkey" not in orders
    assert "LessThan(o_orderdate" in orders


def test_year_reaches_the_resource_scan(spark):
    text = plan(queries()["facility_staff"](spark, SF_DIR))
    items = next(line for line in re.findall(r"FileScan parquet .*", text) if "lineitem.parquet" in line)
    assert "GreaterThanOrEqual(l_shipdate" in items
    assert "l_extendedprice" not in items


def test_adaptive_execution_splits_a_hot_customer(spark):
    """The line list joins two plain scans, so a hot key is split without our help."""
    with small_partitions(spark):
        hot = spark.range(0, 400_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("c_custkey"),
            F.hash("id").alias("v"),
        )
        other = spark.range(5000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("area"))
        df = hot.join(other, "c_custkey").groupBy("area").agg(F.count("*").alias("n"))
        assert sum(r["n"] for r in df.collect()) == 400_000
        assert "skew=true" in plan(df, executed=True)


def test_adaptive_execution_splits_a_point_where_many_areas_meet(spark):
    """A third of all boundary points is one point; its pairs are made by several tasks."""
    with small_partitions(spark):
        corner = spark.range(0, 3000, 1, 8).selectExpr("id AS geo_id", "0.0D AS x", "0.0D AS y")
        others = spark.range(0, 6000, 1, 8).selectExpr(
            "id + 10000 AS geo_id", "1.0D + id AS x", "1.0D AS y"
        )
        df = graph._pairs_sharing(corner.unionByName(others), ["x", "y"])
        assert df.count() == 3000 * 2999 // 2
        assert "skew=true" in plan(df.agg(F.count("*")), executed=True)


def test_contiguity_shuffles_its_points_once(spark):
    """Both sides of the point join read one exchange."""
    text = plan(graph.contiguity(bindings.customer_squares(spark, SF_DIR)), executed=True)
    assert "ReusedExchange" in text


@pytest.mark.parametrize("name", ["feature_table_v1", "feature_table_v2"])
def test_the_case_list_is_read_once(spark, name, monkeypatch):
    read = []
    before = bindings.table

    def counted(session, folder, table):
        read.append(table)
        return before(session, folder, table)

    monkeypatch.setattr(bindings, "table", counted)
    text = plan(queries()[name](spark, SF_DIR))
    assert read.count("orders") == 1 and "orders.parquet" not in text


def test_grouping_combines_before_its_shuffle(spark):
    text = plan(queries()["simple_graph"](spark, SF_DIR))
    assert text.count("partial_sum") >= 1
