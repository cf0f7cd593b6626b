"""The most popular keys, and restricting a table to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_popular(df: DataFrame, by: str, n: int) -> DataFrame:
    """Top n keys by distinct tasks; ties go to the smaller key."""
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.countDistinct("jeditaskid").alias("n_tasks"))
        .orderBy(F.desc("n_tasks"), F.asc(by))
        .limit(n)
    )


def keep_popular(df: DataFrame, by: str, popular: DataFrame) -> DataFrame:
    """Rows whose key is in the popular list."""
    return df.join(popular.select(by), by, "left_semi")


def multi_user(df: DataFrame, key: str = "datasetname") -> DataFrame:
    """Rows of datasets that more than one user touched."""
    shared = df.groupBy(key).agg(F.countDistinct("username").alias("n")).where("n > 1")
    return df.join(shared.select(key), key, "left_semi")
