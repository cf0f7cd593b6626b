"""States by day, from which reports over any look-back are merged without the records.

Look-backs begin and end at midnight and hold both ends. A day's states are therefore kept
in two parts: the records of its first instant, which close a look-back that ends there,
and all others. Each batch of records adds states of its own under its days; a batch that
is written again replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookbacks import band, end_of, start_of

DAY, INSTANT, BATCH = "day", "first_instant", "batch"


def with_day(df: DataFrame, time_col: str) -> DataFrame:
    """Records that have a time, with its day and whether it is the day's first instant."""
    time = F.col(time_col)
    day = time.cast("date")
    return df.where(time.isNotNull()).withColumns({DAY: day, INSTANT: time == day.cast("timestamp_ntz")})


def write_states(states: DataFrame, path: str, batch: str) -> None:
    """States of a batch, one folder for each day and batch."""
    rows = states.withColumn(BATCH, F.lit(batch)).hint("rebalance", F.col(DAY))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY, BATCH).parquet(path)


def read_states(spark: SparkSession, path: str, as_of: str, lookbacks: dict[str, int]) -> DataFrame:
    """States of the longest look-back with their band; only its days are listed and read."""
    if not as_of.endswith("00:00:00"):
        raise ValueError("look-backs from states end at midnight")
    last = end_of(as_of).cast("date")
    first = start_of(as_of, max(lookbacks.values())).cast("date")
    states = spark.read.parquet(path)
    inside: Column = F.col(DAY).between(first, last) & ((F.col(DAY) < last) | F.col(INSTANT))
    return states.where(inside).withColumn("band", band(as_of, lookbacks, DAY))
