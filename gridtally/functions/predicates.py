"""Row filters as ``Column`` conjunctions (they reach the parquet scan)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the quality filter.
FIRST_ATTEMPT = 0
FINISHED_JOB = "finished"
GOOD_ATTEMPTS = ("finished", "done")
GPU_QUEUE = ("GPU", "gpu")
SCOPE_13TEV = "_13TeV"
NON_PHYSICS_NAMES = ("debug", "hlt", "scout", "calib")
# Fixed values of the storage accounting filter.
ACCOUNTING_FIELDS = (
    "account campaign country cloud datatype datatype_grouped prod_step provenance "
    "rse scope experiment_site stream_name tier token tombstone"
).split()
UNKNOWN_TOMBSTONE = "UNKNOWN"
NO_ENDPOINT = "none"


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def first_good_attempt(attempt_status: Iterable[str] = GOOD_ATTEMPTS) -> Column:
    return (
        (F.col("task_attemptnr") == FIRST_ATTEMPT)
        & (F.col("jobstatus") == FINISHED_JOB)
        & F.col("attempt_status").isin(*attempt_status)
    )


def not_gpu(queue: str = "queue") -> Column:
    """Queue is not a GPU queue; a missing queue passes."""
    name = F.col(queue)
    return name.isNull() | all_of(~name.contains(word) for word in GPU_QUEUE)


def in_13tev(scope: str = "ds_scope") -> Column:
    return F.col(scope).contains(SCOPE_13TEV)


def quality(
    *,
    data_type: str | Iterable[str] | None = None,
    project: str | Iterable[str] | None = None,
    subtype: str | None = None,
    prod_step: str | None = None,
    attempt_status: Iterable[str] = GOOD_ATTEMPTS,
    exclude_gpu: bool = False,
    only_13tev: bool = False,
) -> Column:
    """First finished attempts, narrowed by whichever attributes are given."""
    conditions = [first_good_attempt(attempt_status)]
    for column, wanted in (
        ("ds_data_type", data_type),
        ("ds_scope", project),
        ("ds_data_type_desc", subtype),
        ("ds_prod_step", prod_step),
    ):
        if isinstance(wanted, str):
            conditions.append(F.col(column) == wanted)
        elif wanted is not None:
            conditions.append(F.col(column).isin(*wanted))
    if exclude_gpu:
        conditions.append(not_gpu())
    if only_13tev:
        conditions.append(in_13tev())
    return all_of(conditions)


def quality_filter(df: DataFrame, **options) -> DataFrame:
    return df.where(quality(**options))


def between(time_col: str, start, end) -> Column:
    """Inclusive time range."""
    return F.col(time_col).between(F.lit(start), F.lit(end))


def half_open(time_col: str, start, end) -> Column:
    return (F.col(time_col) >= F.lit(start)) & (F.col(time_col) < F.lit(end))


def not_null(*columns: str) -> Column:
    return all_of(F.col(c).isNotNull() for c in columns)


def training_rows(marker: str) -> Column:
    """Subtype holds ``marker``; name is none of the non-physics streams."""
    name = F.col("datasetname")
    return all_of(
        [F.col("ds_data_type_desc").contains(marker)]
        + [~name.contains(word) for word in NON_PHYSICS_NAMES]
    )


def accounting_rows(start, end) -> Column:
    """Complete accounting documents of a live endpoint within ``[start, end]``."""
    return (
        not_null(*ACCOUNTING_FIELDS)
        & (F.col("tombstone") != UNKNOWN_TOMBSTONE)
        & ~F.col("rse").contains(NO_ENDPOINT)
        & between("timestamp", start, end)
    )
