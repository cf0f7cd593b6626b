"""Folders that every executor can reach, for tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names, or else one below its warehouse.

    Both are the cluster's own shared storage; no machine's temporary folder is used.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the cluster's storage has that folder."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its storage and from the root, as it means the same everywhere."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(target).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in that folder; none where there is no such folder."""
    if not exists(spark, path):
        return []
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(target)
    return [status.getPath().getName() for status in found]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the cluster's storage."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
