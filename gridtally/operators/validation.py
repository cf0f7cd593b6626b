"""Checking advice against later use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import time_bounds
from ..functions.scalars import plus_seconds, seconds, verdict


def next_period_validation(advice: DataFrame, next_df: DataFrame) -> DataFrame:
    """Accesses in the next period beside the advice, with a verdict per dataset."""
    later = (
        next_df.where(F.col("datasetname").isNotNull())
        .groupBy("datasetname")
        .agg(F.countDistinct("jeditaskid").alias("next_week_accesses"))
    )
    return advice.join(later, "datasetname", "left").withColumn(
        "validator",
        verdict(F.col("next_week_accesses"), F.col("curr_n_accesses"), F.col("decision")),
    )


def split_time(df: DataFrame, *, days: int = 60, time_col: str = "task_modificationtime") -> Column:
    """The cut between training and validation, as a scalar."""
    return plus_seconds(time_bounds(df, time_col)["start"], F.lit(days * 86400))


def train_split(
    df: DataFrame, *, days: int = 60, time_col: str = "task_modificationtime"
) -> tuple[DataFrame, DataFrame]:
    """Records before the cut, and records from the cut to the end."""
    cut = split_time(df, days=days, time_col=time_col)
    return df.where(F.col(time_col) < cut), df.where(F.col(time_col) >= cut)


def split_label(
    df: DataFrame, *, days: int = 60, time_col: str = "task_modificationtime"
) -> Column:
    """``train`` or ``validate`` for each record with a time."""
    first = time_bounds(df, time_col)["lo"]
    s = seconds(time_col)
    return F.when(s < first + days * 86400, "train").when(s.isNotNull(), "validate")
