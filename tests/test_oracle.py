"""Every registered query against its SQL on the small tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_point
from gridtally.plans.catalog import QUERIES
from gridtally.plans.oracle import ORACLE_SQL as ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert "optimal_n_replicas" in df.columns
    assert df.count() > 0
