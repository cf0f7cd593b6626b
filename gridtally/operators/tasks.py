"""Execution of the tasks that read a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import between, not_null

# The group keys of the report.
TASK_KEYS = [
    "jeditaskid",
    "institute_name",
    "task_status",
    "ds_replicas_sites",
    "site_name",
    "jobstatus",
]


def task_execution(
    df: DataFrame,
    *,
    start: str,
    end: str,
    dataset: str | None = None,
    time_col: str = "task_modificationtime",
) -> DataFrame:
    """Jobs per task, institute, status, replica sites, site and job status.

    Of one dataset, or of every dataset with its name as a further key.
    """
    bound = [F.lit(t).cast("timestamp_ntz") for t in (start, end)]
    df = df.where(between(time_col, *bound))
    keys = TASK_KEYS
    if dataset is not None:
        df = df.where(F.col("datasetname") == dataset)
    else:
        keys = ["datasetname", *TASK_KEYS]
    return (
        df.where(not_null(*keys))
        .groupBy(*keys)
        .agg(F.coalesce(F.sum("number_of_jobs"), F.lit(0)).alias("number_of_jobs"))
    )
