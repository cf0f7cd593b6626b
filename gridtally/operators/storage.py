"""What sites hold, process and read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import exact_sum
from ..functions.predicates import not_null
from ..functions.scalars import TB, div, percent, site_is_replica

# Codes of where the data of a record came from.
LOCALITY = {"local_accessed": 1, "remote_accessed": 2, "staged_in_from_TAPE": 3}


def replica_inventory(df: DataFrame) -> DataFrame:
    """Replicas and their volume per replica site, in bytes.

    A dataset counts once at a site; its volume there sums the distinct
    (replica list, size) pairs seen.
    """
    held = (
        df.select("datasetname", "ds_replicas_sites", "ds_bytes")
        .where(F.col("ds_replicas_sites").isNotNull())
        .distinct()
    )
    per_dataset = (
        held.select(
            F.explode(F.split("ds_replicas_sites", ",")).alias("ds_replicas_sites"),
            "datasetname",
            "ds_bytes",
        )
        .where(F.col("datasetname").isNotNull())
        .groupBy("ds_replicas_sites", "datasetname")
        .agg(F.sum("ds_bytes").alias("ds_bytes"))
    )
    return per_dataset.groupBy("ds_replicas_sites").agg(
        F.count("datasetname").alias("n_replicas"),
        exact_sum("ds_bytes").alias("replicas_volume"),
    )


def processed_by_site(df: DataFrame) -> DataFrame:
    """Datasets and input volume processed per site, in bytes."""
    seen = (
        df.select("site_name", "datasetname", "jobs_primary_input_fsize")
        .where(not_null("site_name", "datasetname"))
        .distinct()
    )
    per_dataset = seen.groupBy("site_name", "datasetname").agg(
        exact_sum("jobs_primary_input_fsize").alias("fsize")
    )
    # one row per (site, dataset) by now, so a plain count is the distinct count
    return per_dataset.groupBy("site_name").agg(
        F.count("datasetname").alias("n_datasets"),
        F.sum("fsize").alias("processed_data_volume"),
    )


def inventory_and_processing(df: DataFrame, n: int | None = None) -> DataFrame:
    """Replicas held beside data processed, in TB, most replicas first."""
    held = replica_inventory(df)
    done = processed_by_site(df)
    joined = held.join(done, held["ds_replicas_sites"] == done["site_name"], "left").select(
        "ds_replicas_sites",
        "n_replicas",
        div("replicas_volume", TB).alias("replicas_volume"),
        "n_datasets",
        div("processed_data_volume", TB).alias("processed_data_volume"),
    )
    joined = joined.orderBy(F.desc("n_replicas"), F.asc("ds_replicas_sites"))
    return joined if n is None else joined.limit(n)


def storage_locality(df: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volume read locally, remotely and from tape per site, against its stored volume.

    Volumes in TB, shares in percent. A site keeps its remote and tape columns
    when it had no local access; the total is missing if any part is.
    """
    read = (
        df.where(F.col("ds_replicas_sites").isNotNull())
        .where(not_null("site_name", "site_cloud"))
        .where(F.col("is_local").isin(*LOCALITY.values()))
        .select("datasetname", "site_name", "site_cloud", "ds_bytes", "is_local")
        .distinct()
    )
    size = F.coalesce("ds_bytes", F.lit(0)).cast("decimal(20,0)")
    per_site = read.groupBy("site_name", "site_cloud").agg(
        *[
            F.sum(F.when(F.col("is_local") == code, size)).alias(name)
            for name, code in LOCALITY.items()
        ]
    )
    parts = [F.col(name) for name in LOCALITY]
    total = parts[0] + parts[1] + parts[2]
    report = volumes.join(per_site, "site_name", "left")
    stored = F.col("total_volume")
    return report.select(
        "site_name",
        "site_cloud",
        div("total_volume", TB).alias("total_volume"),
        *[div(name, TB).alias(name) for name in LOCALITY],
        percent(parts[0], stored).alias("local%"),
        percent(parts[1], stored).alias("remote%"),
        percent(parts[2], stored).alias("from_TAPE%"),
        div(total, TB).alias("total_accessed"),
        percent(total, stored).alias("total_accessed%"),
    ).orderBy(F.desc("total_volume"), F.asc("site_name"), F.asc("site_cloud"))


def with_local_flag(df: DataFrame) -> DataFrame:
    """Does the site that ran the record hold a replica of its dataset?"""
    return df.withColumn("local", site_is_replica("site_name", "ds_replicas_sites"))
