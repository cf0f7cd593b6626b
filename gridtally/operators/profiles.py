"""Profiles of a log, stored once and shared by several jobs.

A profile is a table of one row per dataset, or per dataset and place, bucketed and sorted
by dataset. Jobs that start from it join, rank and add up by dataset where the rows are
stored: the log is neither read nor shuffled again, and no profile is shuffled at all.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import time_bounds
from ..sources.workspace import fresh_path
from .frequency import (
    DATASET,
    PLACE,
    PLACE_COLUMNS,
    access_profile,
    frequency_of,
    placement_of,
    profile_with_latest_mean,
    shares_of,
    use_of,
)

BUCKETS = 256


def store_by_dataset(df: DataFrame, table: str, *, buckets: int = BUCKETS) -> None:
    """A catalogue table with one file per bucket of the dataset."""
    path = fresh_path(df.sparkSession, table)
    writer = df.repartition(buckets, DATASET).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, DATASET).sortBy(DATASET).saveAsTable(table)


def write_profiles(
    df: DataFrame,
    name: str,
    *,
    n: int = 10,
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
    buckets: int = BUCKETS,
) -> None:
    """Tables ``<name>_dataset``, ``<name>_cloud`` and ``<name>_site`` of the log."""
    bounds = time_bounds(df, time_col)
    named = df.where(F.col(DATASET).isNotNull())
    options = {"time_col": time_col, "count_col": count_col}
    whole = profile_with_latest_mean(named, bounds, n, value_col="ds_replicas_number", **options)
    store_by_dataset(whole, f"{name}_dataset", buckets=buckets)
    for place, column in PLACE_COLUMNS.items():
        profile = access_profile(named, bounds, n, keys=[DATASET, column], **options)
        store_by_dataset(profile.withColumnRenamed(column, PLACE), f"{name}_{place}", buckets=buckets)


def intervals_of(profile: DataFrame) -> int:
    return sum(bool(re.fullmatch(r"n_\d+", c)) for c in profile.columns)


def stored_frequency(spark: SparkSession, name: str, *, scheme: str = "newest_half") -> DataFrame:
    """``dataset_frequency`` of the log behind the profiles."""
    profile = spark.table(f"{name}_dataset")
    return frequency_of(profile, intervals_of(profile), scheme)


def stored_shares(
    spark: SparkSession, name: str, place: str, *, scheme: str = "newest_half", places: list[str] | None = None
) -> DataFrame:
    """``place_shares`` of the log behind the profiles."""
    profile = spark.table(f"{name}_{place}")
    n = intervals_of(profile)
    return shares_of(stored_frequency(spark, name, scheme=scheme), use_of(profile, places, n, scheme), place, n)


def stored_placement(
    spark: SparkSession,
    name: str,
    prior_advice: DataFrame,
    place: str,
    *,
    scheme: str = "newest_one",
    places: list[str] | None = None,
) -> DataFrame:
    """``placement`` of the log behind the profiles.

    Advice that :func:`store_by_dataset` has stored in as many buckets is joined without a shuffle.
    """
    profile = spark.table(f"{name}_{place}")
    n = intervals_of(profile)
    return placement_of(use_of(profile, places, n, scheme), prior_advice, place, n)
