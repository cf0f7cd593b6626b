"""Schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

# The declared fields of a data-access record, one list per type.
DATE_FIELDS = """
@timestamp attempt_defined_first attempt_finished attempt_ready_first
attempt_running_first attempt_scouting_first attempt_start ds_closed_at
ds_created_at ds_deleted_at jobs_creationtime jobs_endtime jobs_starttime
task_creationdate task_end_time task_modificationtime task_start_time
""".split()

LONG_FIELDS = """
attempt_defined_delta attempt_exhausted_delta attempt_pending_delta
attempt_ready_delta attempt_ready_run_delay attempt_running_delta
attempt_throttled_delta attempt_total_duration ds_access_cnt ds_bytes
ds_dataset_number ds_run_number jeditaskid jobs_cpuconsumptiontime
jobs_total_duration jobs_inputfilebytes jobs_ninputdatafiles
jobs_noutputdatafiles jobs_outputfilebytes jobs_total_walltime number_of_jobs
queue_corecount queue_maxinputsize queue_maxrss queue_maxswap queue_maxtime
queue_maxwdir
""".split()

SHORT_FIELDS = """
ds_nfiles ds_nfilesfailed ds_nfilesfininshed queue_nodes task_attemptnr
""".split()

BYTE_FIELDS = "ds_replicas_number tier_level".split()

DOUBLE_FIELDS = "queue_corepower site_corepower".split()

KEYWORD_FIELDS = """
attempt_status dataset_status ds_data_type ds_did_type ds_prod_step ds_type
gshare institute_country jobstatus queue queue_status region resource_type
site_cloud site_country site_grid_flavour site_name site_state task_status
""".split()

TEXT_FIELDS = """
campaign containername datasetname ds_ami_tags ds_name ds_physics_short
ds_project ds_replicas_ddm ds_replicas_sites ds_replicas_clouds ds_scope
ds_stream_name institute_name username
""".split()

GEO_POINT_FIELDS = "institute_location site_location".split()

NESTED_FIELDS = ["ds_replicas_info"]

# Fields the jobs read although no mapping declares them.
UNDECLARED_LONG_FIELDS = """
jobs_timetostart jobs_total_inputfilebytes jobs_total_outputfilebytes
jobs_primary_input_fsize
""".split()

GEO_POINT = T.StructType(
    [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
)


def declared_schema(replica_info: T.DataType | None = None) -> T.StructType:
    """The declared record as a Spark schema: no inference, dates without a zone.

    The nested column has the caller's type, or stays text.
    """
    replica_info = replica_info or T.StringType()
    by_type = [
        (DATE_FIELDS, T.TimestampNTZType()),
        (LONG_FIELDS, T.LongType()),
        (SHORT_FIELDS, T.ShortType()),
        (BYTE_FIELDS, T.ByteType()),
        (DOUBLE_FIELDS, T.DoubleType()),
        (KEYWORD_FIELDS, T.StringType()),
        (TEXT_FIELDS, T.StringType()),
        (GEO_POINT_FIELDS, GEO_POINT),
        (NESTED_FIELDS, replica_info),
    ]
    fields = [T.StructField(n, t) for names, t in by_type for n in names]
    return T.StructType(sorted(fields, key=lambda f: f.name))


ACCESS_LOG_DDL = """
    jeditaskid bigint, datasetname string, ds_scope string, ds_data_type string,
    ds_data_type_desc string, ds_prod_step string, ds_bytes bigint,
    ds_replicas_number tinyint, ds_replicas_sites string, username string,
    institute_name string, institute_country string, site_name string,
    site_cloud string, queue string, task_attemptnr smallint, jobstatus string,
    attempt_status string, task_status string, attempt_start timestamp_ntz,
    task_creationdate timestamp_ntz, task_modificationtime timestamp_ntz,
    number_of_jobs bigint, jobs_timetostart bigint, jobs_total_duration bigint,
    jobs_total_walltime bigint, jobs_cpuconsumptiontime bigint,
    attempt_total_duration bigint, attempt_ready_run_delay bigint,
    attempt_pending_delta bigint, attempt_running_delta bigint,
    attempt_ready_delta bigint, jobs_total_inputfilebytes bigint,
    jobs_total_outputfilebytes bigint, jobs_primary_input_fsize bigint,
    is_local int
"""

PRIOR_ADVICE_DDL = """
    datasetname string, datasetAF double, groupAF double, curr_n_replicas int,
    optimal_n_replicas double, decision double, curr_n_accesses bigint
"""

SITE_VOLUME_DDL = "site_name string, total_volume bigint"

WEEKLY_ADVICE_DDL = """
    datasetname string, datasetAF double, groupAF double, curr_n_replicas int,
    curr_n_accesses bigint, curr_n_users bigint, optimal_n_replicas double,
    ds_size_GB double, timestamp timestamp_ntz
"""

# The key names of the nested accounting answer, outermost first.
BUCKET_LEVELS = [
    ("data_site", "site"),
    ("data_datatype", "datatype"),
    ("data_datatype_grouped", "datatypeg"),
    ("data.prod_step", "prodstep"),
    ("data_scope", "scope"),
]
BUCKET_VALUE = "data_bytes"


def bucket_tree_ddl() -> str:
    """DDL of the nested accounting answer, five bucket levels deep."""
    inner = f"`{BUCKET_VALUE}`: struct<value: double>"
    for name, _ in reversed(BUCKET_LEVELS):
        inner = f"`{name}`: struct<buckets: array<struct<key: string, {inner}>>>"
    return f"responses array<struct<aggregations: struct<{inner}>>>"
