"""Reports from daily states equal those from the records."""

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

import gridtally as gt
from gridtally.functions.measures import Metric
from gridtally.operators import overview, utilisation
from gridtally.plans.fixtures import access_log

SF = "/root/testdata/sf0.001"
AS_OF = "2001-06-01 00:00:00"


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def rows_of(df):
    return sorted((tuple(df.select(*sorted(df.columns)).collect())), key=repr)


@pytest.fixture(scope="module")
def moved(spark):
    """Records moved to the edges of the look-backs: the instants there, before and after them."""
    rng = random.Random(2)
    end = dt.datetime(2001, 6, 1)
    times = [None]
    for days in (0, 1, 7, 30, 60, 61):
        times += [end - dt.timedelta(days=days, seconds=s) for s in (-1, 0, 1)]
    ids = [(i, rng.choice(times)) for i in range(9000)]
    moments = spark.createDataFrame(ids, "i int, task_modificationtime timestamp_ntz")
    log = access_log(spark, SF).limit(9000).drop("task_modificationtime")
    log = log.withColumn("i", F.pmod(F.xxhash64("jeditaskid", "number_of_jobs", "site_name"), F.lit(9000)).cast("int"))
    return log.join(moments, "i").drop("i").cache()


def batches(df):
    part = F.pmod(F.xxhash64("jeditaskid", "site_name"), F.lit(3))
    return [(f"b{k}", df.where(part == k)) for k in (0, 1, 2, 1)]


def test_popularity_from_states(spark, folder, moved):
    for name, batch in batches(moved):
        overview.write_popularity_states(batch, folder, name)
    got = overview.popularity_from_states(spark, folder, as_of=AS_OF)
    want = gt.overall_popularity(moved, as_of=AS_OF)
    assert got.columns == want.columns and want.count() > 0
    assert rows_of(got) == rows_of(want)
    text = got._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(day", text)
    with pytest.raises(ValueError, match="midnight"):
        overview.popularity_from_states(spark, folder, as_of="2001-06-01 00:00:05")


def test_site_metrics_from_states(spark, folder, moved):
    df = gt.with_fractions(moved)
    metrics = [
        *utilisation.REPORT_METRICS,
        Metric("rows", "jobs_timetostart", "count", "sum"),
        Metric("least", "jobs_timetostart", "min", "min"),
        Metric("average", "jobs_timetostart", "mean", "mean"),
    ]
    for name, batch in batches(df):
        utilisation.write_site_states(batch, folder, name, metrics)
    got = utilisation.site_metrics_from_states(spark, folder, metrics, as_of=AS_OF)
    want = utilisation.site_metrics(df, metrics, as_of=AS_OF)
    assert got.columns == want.columns and want.count() > 0
    # Ratios are sums of doubles, whose last digits follow the order of the rows.
    near = [F.round(F.col(f"`{c}`"), 9).alias(c) if dict(want.dtypes)[c] == "double" else F.col(f"`{c}`") for c in want.columns]
    assert rows_of(got.select(*near)) == rows_of(want.select(*near))
    with pytest.raises(ValueError, match="cannot be merged"):
        utilisation.write_site_states(df, folder, "q", [Metric("m", "jobs_timetostart", "median", "mean")])
