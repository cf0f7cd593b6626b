"""Extracts of the access log that other jobs start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import quality, training_rows

# Attributes and columns of the two extracts.
TRAINING_MARKER = "TOPQ"
SUBSET_TYPE = "SUSY1"
SUBSET_COLUMNS = """
datasetname ds_replicas_number attempt_total_duration ds_bytes jeditaskid
attempt_ready_run_delay attempt_ready_delta site_name site_cloud
jobs_primary_input_fsize jobs_timetostart jobs_total_duration number_of_jobs
attempt_start jobs_total_inputfilebytes jobs_total_outputfilebytes
""".split()
PREPARED_COLUMNS = """
datasetname attempt_start number_of_jobs ds_replicas_number site_name site_cloud
jeditaskid ds_replicas_clouds ds_replicas_sites
""".split()


def training_extract(
    df: DataFrame,
    *,
    marker: str = TRAINING_MARKER,
    project: str = "mc16_13TeV",
    data_type: str = "DAOD",
) -> DataFrame:
    """Good records of one physics group's derivations."""
    return df.where(quality(data_type=data_type, project=project) & training_rows(marker))


def subset_extract(
    df: DataFrame,
    *,
    subtype: str = SUBSET_TYPE,
    project: str = "mc16_13TeV",
    data_type: str = "DAOD",
    prod_step: str = "deriv",
    project_col: str = "ds_project",
) -> DataFrame:
    """The columns of one subtype's completed attempts."""
    wanted = quality(
        data_type=data_type, subtype=subtype, prod_step=prod_step, attempt_status=("done",)
    )
    return df.where(wanted & (F.col(project_col) == project)).select(*SUBSET_COLUMNS)


def prepared_extract(df: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """Good records with the columns the frequency jobs read."""
    keep = [c for c in columns or PREPARED_COLUMNS if c in df.columns]
    return df.where(quality(**options)).select(*keep)
