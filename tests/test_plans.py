"""Shape of the physical plans, with every table treated as too large to broadcast."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import gridtally as gt
from gridtally.functions import predicates
from gridtally.operators import profiles
from gridtally.plans.catalog import QUERIES
from gridtally.plans.fixtures import access_log, accounting_documents

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture()
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


JOBS = """
replication_advice interval_access dataset_frequency cloud_shares placement_site
advice_by_project frequency_for_list next_period_validation rolling_advice
advice_outcome utilisation_sites utilisation_clouds metric_pivot_median
single_dataset_wide overall_popularity replica_inventory storage_locality
site_accounting upsert_by_task doc_id_dedup
""".split()


@pytest.mark.parametrize("name", JOBS)
def test_no_costly_operator(spark, no_auto_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "Python"):
        assert bad not in text
    # a window must be split by a key
    assert not re.search(r"Window \[[^\n]*\], \[[^\n\]]* (ASC|DESC)[^\n\]]*\]$", text)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    access_log(spark, SF).write.parquet(path)
    log = spark.read.parquet(path)
    wanted = log.where(predicates.quality(data_type="DAOD", project="mc16_13TeV"))
    text = formatted(wanted.groupBy("datasetname").agg(F.countDistinct("jeditaskid")))
    for pushed in ("EqualTo(task_attemptnr,0)", "EqualTo(ds_scope,mc16_13TeV)", "In(attempt_status"):
        assert pushed in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "jobs_total_duration" not in schema


def test_accesses_are_spread_over_tasks_and_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "log")
    access_log(spark, SF).write.parquet(path)
    advice = gt.replication_advice(spark.read.parquet(path))
    advice.collect()
    text = plan(advice)
    assert re.search(r"hashpartitioning\(datasetname#\d+, _i#\d+, _what#\d+L", text)
    assert "ReusedExchange [datasetname" in text


def test_duplicate_ids_are_cut_before_the_shuffle(spark):
    text = plan(QUERIES["doc_id_dedup"](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize("name", [*JOBS, "metric_pivot", "inventory_and_processing", "backfill"])
def test_building_a_plan_starts_no_job(spark, name):
    spark.sparkContext.setJobGroup(f"plan of {name}", "")
    QUERIES[name](spark, SF)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"plan of {name}")


def test_large_ranks_run_in_parts(spark):
    """Beyond a thousand Spark no longer cuts a rank's rows before the shuffle."""
    log = access_log(spark, SF)
    text = plan(gt.metric_pivot(log, "number_of_jobs", "sum", by="datasetname", limit=2000))
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(site_cloud#\d+, _part#\d+", text)


def test_limits_of_all_levels_share_one_scan(spark, no_auto_broadcast, tmp_path):
    path = str(tmp_path / "documents")
    accounting_documents(spark, SF).write.parquet(path)
    documents = spark.read.parquet(path)
    rows = gt.site_accounting(documents, "1992-01-01 00:00:00", "2002-01-01 00:00:00", keys_per_level=2)
    rows.collect()
    text = plan(rows).split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") == 1
    assert text.count("FileScan") == 1
    assert len(re.findall(r"[+:]- Exchange hashpartitioning", text)) < 8


def test_jobs_from_stored_profiles_shuffle_nothing(spark, no_auto_broadcast):
    name = f"plan_{uuid.uuid4().hex}"
    log = access_log(spark, SF)
    profiles.write_profiles(log, name, buckets=4)
    profiles.store_by_dataset(gt.replication_advice(log), f"{name}_advice", buckets=4)
    jobs = [
        profiles.stored_frequency(spark, name),
        profiles.stored_shares(spark, name, "cloud"),
        profiles.stored_shares(spark, name, "site"),
        profiles.stored_placement(spark, name, spark.table(f"{name}_advice"), "site"),
    ]
    for k, job in enumerate(jobs):
        text = plan(job)
        assert k == 0 or "Bucketed: true" in text  # the first has nothing to join
        assert "Exchange hashpartitioning" not in text
        assert not re.search(r"Exchange (?!SinglePartition)", text)


def test_rolling_counts_shuffle_no_more_rows_than_visits(spark, tmp_path):
    """Exchange by exchange: none gets more rows than the log has, though a record is in nine windows.

    Few datasets with many visits each, for the result itself has a row per window and dataset.
    """
    path = str(tmp_path / "log")
    few = F.concat(F.lit("d"), F.pmod(F.xxhash64("jeditaskid"), F.lit(5)))
    access_log(spark, SF).withColumn("datasetname", few).coalesce(1).write.parquet(path)
    log = spark.read.parquet(path)
    rows = gt.rolling_advice(log)
    rows.collect()
    written, waiting = [], [rows._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            waiting.append(node.plan())
        elif name == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    assert written and max(written) <= log.count()
    assert "InMemoryTableScan" not in plan(rows)


def test_one_counted_value_is_made_distinct_once(spark):
    """Groups by site and user are held by one aggregate on either side of their shuffle, not by three."""
    text = plan(QUERIES["dashboard_clouds"](spark, SF))
    assert len(re.findall(r"HashAggregate\(keys=\[[^\]]*username", text)) == 2


def test_readers_of_the_outcome_share_the_shuffle_of_the_log(spark, no_auto_broadcast, tmp_path):
    """Whatever reads the log does so below the same shuffle, and use by window is not shuffled."""
    path = str(tmp_path / "log")
    access_log(spark, SF).write.parquet(path)
    log = spark.read.parquet(path)
    text = plan(gt.advice_outcome(gt.rolling_advice(log), gt.rolling_calendar(log)))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == len(re.findall(r"Exchange hashpartitioning\(r#\d+, \d+\)", text))
    assert not re.search(r"hashpartitioning\(k#\d+L, datasetname", text)
