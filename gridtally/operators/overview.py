"""Overall popularity of (project, data type) groups over several look-backs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import BATCH, DAY, INSTANT, read_states, with_day, write_states
from ..functions.lookbacks import band, lookbacks_of, within_longest
from ..functions.measures import exact_sum, is_whole
from ..functions.predicates import not_null, quality
from ..functions.scalars import MINUTE, TIB, div, queue_seconds, strip_digits

# Look-back labels in days, and the report's column names.
POPULARITY_LOOKBACKS = {"Last Week": 7, "Last Month": 30, "Last 2 Months": 60}
DISTINCT_COLUMNS = {
    "jeditaskid": "n_tasks",
    "username": "n_users",
    "institute_name": "n_institutes",
    "institute_country": "n_countries",
    "site_name": "n_sites",
    "site_cloud": "n_clouds",
    "datasetname": "n_datasets",
}
SUM_COLUMNS = {
    "number_of_jobs": ("n_jobs", 1),
    "jobs_total_inputfilebytes": ("input_TB", TIB),
    "jobs_total_outputfilebytes": ("output_TB", TIB),
}
MEAN_COLUMNS = {
    "attempt_total_duration": ("attempt_duration(min)", MINUTE),
    "attempt_ready_run_delay": ("attempt_ready_run_delay(min)", 1),
    "attempt_pending_delta": ("attempt_pending(min)", 1),
    "attempt_running_delta": ("attempt_running(min)", 1),
    "attempt_ready_delta": ("attempt_ready_delta", 1),
    "queue_seconds": ("queue_time(min)", MINUTE),
    "ds_replicas_number": ("replication_factor", 1),
}
REPORT_ORDER = [
    "n_tasks",
    "n_jobs",
    "n_users",
    "n_institutes",
    "n_countries",
    "attempt_duration(min)",
    "attempt_ready_run_delay(min)",
    "attempt_pending(min)",
    "attempt_running(min)",
    "attempt_ready_delta",
    "queue_time(min)",
    "n_sites",
    "n_clouds",
    "input_TB",
    "output_TB",
    "n_datasets",
    "replication_factor",
]


def overall_popularity(
    df: DataFrame,
    *,
    as_of: str,
    lookbacks: dict[str, int] | None = None,
    data_type: str = "DAOD",
    time_col: str = "task_modificationtime",
) -> DataFrame:
    """Seventeen aggregates per (look-back, project, type); missing values are 0.

    A record lies in one time band and a look-back is a run of bands. Sums and
    counts are taken per band and added up. For a distinct count each value keeps
    its newest band, which says in one pass to which look-backs it belongs; seven
    distinct counts over three look-backs thus cost seven narrow rows per record,
    combined on the map side, and no copy of the record per look-back.
    """
    lookbacks = lookbacks or POPULARITY_LOOKBACKS
    df = within_longest(df, as_of, lookbacks, time_col)
    df = _grouped(df, data_type).withColumn("band", band(as_of, lookbacks, time_col))
    return _report(_sums(df, ["band"]), _values(df, "band"), as_of, lookbacks)


KEYS = ["ds_scope", "ds_data_type_desc"]


def write_popularity_states(
    df: DataFrame, path: str, batch: str, *, data_type: str = "DAOD", time_col: str = "task_modificationtime"
) -> None:
    """The states of a batch of records, from which :func:`popularity_from_states` reports.

    Sums and counts per day and group, and the distinct values of a day and group: exact, and
    merged with those of other batches when they are read.
    """
    df = with_day(_grouped(df, data_type), time_col)
    write_states(_sums(df, [DAY, INSTANT]), f"{path}/sums", batch)
    write_states(_values(df, DAY, INSTANT), f"{path}/values", batch)


def popularity_from_states(
    spark: SparkSession, path: str, *, as_of: str, lookbacks: dict[str, int] | None = None
) -> DataFrame:
    """:func:`overall_popularity` of all batches written, without their records."""
    lookbacks = lookbacks or POPULARITY_LOOKBACKS
    sums = read_states(spark, f"{path}/sums", as_of, lookbacks).drop(DAY, INSTANT, BATCH)
    values = read_states(spark, f"{path}/values", as_of, lookbacks)
    return _report(sums, values, as_of, lookbacks)


def _grouped(df: DataFrame, data_type: str) -> DataFrame:
    df = df.where(quality(data_type=data_type)).where(not_null(*KEYS))
    return df.withColumn("ds_data_type_desc", strip_digits("ds_data_type_desc"))


def _report(sums: DataFrame, values: DataFrame, as_of: str, lookbacks: dict[str, int]) -> DataFrame:
    """The report from sums and values by group, each row of one band."""
    groups = ["lookback", *KEYS]
    report = (
        sums.withColumn("lookback", F.explode(lookbacks_of("band", lookbacks)))
        .groupBy(*groups)
        .agg(*_merge_additive())
        .join(_distinct(values, lookbacks), groups, "left")
    )
    newest, day = F.lit(as_of).cast("date"), "yyyy-MM-dd"
    oldest = F.lit(None).cast("date")
    for name, days in lookbacks.items():
        oldest = F.when(F.col("lookback") == name, F.date_sub(newest, days)).otherwise(oldest)
    return (
        report.select(*groups, *[F.col(f"`{c}`") for c in REPORT_ORDER])
        .na.fill(0)
        .withColumn("TimestampStart", F.date_format(oldest, day))
        .withColumn("TimestampEnd", F.date_format(newest, day))
    )


def _sums(df: DataFrame, when: list[str]) -> DataFrame:
    created, started = F.col("task_creationdate"), F.col("attempt_start")
    df = df.withColumn("queue_seconds", queue_seconds(created, started))
    sums = [
        (exact_sum(c) if is_whole(df, c) else F.coalesce(F.sum(c), F.lit(0.0))).alias(f"sum_{c}")
        for c in [*SUM_COLUMNS, *MEAN_COLUMNS]
    ]
    counts = [F.count(c).alias(f"count_{c}") for c in MEAN_COLUMNS]
    return df.groupBy(*KEYS, *when).agg(*sums, *counts)


def _merge_additive() -> list:
    merged = []
    for column, (name, unit) in SUM_COLUMNS.items():
        total = F.sum(f"sum_{column}")
        whole = total.cast("bigint") if unit == 1 else total.cast("double") / F.lit(float(unit))
        merged.append(whole.alias(name))
    for column, (name, unit) in MEAN_COLUMNS.items():
        mean = div(F.sum(f"sum_{column}"), F.sum(f"count_{column}"))
        merged.append((mean if unit == 1 else mean / F.lit(float(unit))).alias(name))
    return merged


def _values(df: DataFrame, *when: str) -> DataFrame:
    """A row for each value ``v`` of the j-th counted column, in each of ``when``."""
    values = F.array(
        *[
            F.struct(F.lit(j).alias("j"), F.col(c).cast("string").alias("v"))
            for j, c in enumerate(DISTINCT_COLUMNS)
        ]
    )
    rows = df.select(*KEYS, *when, F.inline(values)).where(F.col("v").isNotNull())
    return rows if when == ("band",) else rows.distinct()


def _distinct(values: DataFrame, lookbacks: dict[str, int]) -> DataFrame:
    newest = values.groupBy(*KEYS, "j", "v").agg(F.min("band").alias("band"))
    per_band = newest.groupBy(*KEYS, "band").agg(
        *[F.count_if(F.col("j") == j).alias(n) for j, n in enumerate(DISTINCT_COLUMNS.values())]
    )
    return (
        per_band.withColumn("lookback", F.explode(lookbacks_of("band", lookbacks)))
        .groupBy("lookback", *KEYS)
        .agg(*[F.sum(n).alias(n) for n in DISTINCT_COLUMNS.values()])
    )
