"""What several operators of this subpackage need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridtally.sources.workspace import fresh_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back, which cuts its lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, used: list[str]) -> DataFrame:
    """The table with other names for all columns but ``used``, so that none clashes with an operator's.

    ``toDF(*docs.columns)`` of the same columns in the same order gives the names back.
    """
    return docs.toDF(*[c if c in used else f"_kept_{i}" for i, c in enumerate(docs.columns)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
