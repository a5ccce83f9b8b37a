import os

import pytest
from oracle_check import differences, duck

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    assert entry(spark).columns == ["CVEGEO", "ola", "defunciones", "casos_totales", "cfr"]


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", [n for n in oracle_sql()])
def test_query_equals_sql(spark, con, name):
    found = differences(queries()[name](spark, SF_DIR), con, oracle_sql()[name])
    assert found == []


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql()])
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF_DIR).take(1)
