"""The access log that Spark joins, against the records of its text."""

import re

import pytest
from pyspark.sql import functions as F

from gridtally.plans import catalog, fixtures

ROWS = {"region": 3, "nation": 9, "customer": 4000, "supplier": 40, "part": 4000, "orders": 8000, "lineitem": 16000}
KEYS = {
    "n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer",
    "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every table, with keys that are missing, found nowhere or found twice."""
    path = str(tmp_path_factory.mktemp("tables"))
    for name, ddl in fixtures.TABLES.items():
        columns = []
        for place, part in enumerate(ddl.split(", ")):
            column, kind = part.split()
            noise = F.xxhash64(F.lit(column), "id")
            if place == 0 and name != "lineitem":
                value = F.when(F.col("id") % 97 == 5, F.col("id") - 1).otherwise(F.col("id"))
            elif column in KEYS:
                value = F.when(F.pmod(noise, F.lit(31)) > 0, F.pmod(noise, F.lit(ROWS[KEYS[column]] + 2)))
            elif kind == "timestamp_ntz":
                value = F.date_add(F.lit("1995-01-01"), F.pmod(noise, F.lit(2400)).cast("int"))
            elif kind == "string":
                value = F.concat(F.lit(column), F.pmod(noise, F.lit(1000)))
            else:
                value = 1 + F.pmod(noise, F.lit(50))
            columns.append(value.cast(kind).alias(column))
        spark.range(ROWS[name]).select(*columns).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def test_the_joined_log_has_the_records_of_its_text(spark, folder):
    tables = {name: fixtures.table(spark, folder, name) for name in fixtures.TABLES}
    want = spark.sql(fixtures.ACCESS_LOG, **tables)
    got = fixtures.access_log(spark, folder)
    assert got.schema == want.schema
    assert want.count() > 1000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_records_are_shuffled_by_part_and_order_only(spark, folder):
    """With sites small enough to broadcast, and parts, orders and customers too large."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        plan = fixtures.access_log(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    shuffled = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(shuffled) == ["c_custkey", "l_orderkey", "l_partkey", "o_custkey", "o_orderkey", "p_partkey"]


STORING = "keyed_twice stream_late replace_stored replace_stored_fewer hourly_batches hourly_compacted".split()


@pytest.mark.parametrize("name", STORING)
def test_records_that_are_stored_are_joined_once(spark, folder, monkeypatch, name):
    """However many batches a query takes from them."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def passes(_):
        seen.add(1)
        return True

    few = fixtures.access_log(spark, folder).where("jeditaskid < 300").localCheckpoint()
    monkeypatch.setattr(catalog, "access_log", lambda *_: few.where(passes("jeditaskid")))
    assert catalog.QUERIES[name](spark, folder).count() > 0
    assert seen.value == few.count()
