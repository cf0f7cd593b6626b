"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(
    df: DataFrame,
    path: str,
    parts: tuple[str, ...] = ("report", "split", "metric"),
    *,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """A long report as one folder per report, sheet and metric block.

    Rows meet by their folder before the write, so each folder gets few files;
    adaptive execution splits a folder too large for one task.
    """
    present = [p for p in parts if p in df.columns]
    writer = df.hint("rebalance", *present).write.mode(mode).partitionBy(*present)
    writer = writer.option("header", True) if fmt == "csv" else writer
    writer.format(fmt).save(path)


def write_fan_out(
    df: DataFrame,
    path: str,
    keys: tuple[str, ...] = ("ds_scope", "ds_data_type"),
    *,
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """One folder per key pair, in a single job."""
    write_report(df, path, keys, fmt=fmt, mode=mode)
