"""The input tables of the registered queries, derived from the given tables.

``ACCESS_LOG`` is valid in Spark SQL and in DuckDB alike. Spark reads the same records
by other joins (``SPARK_JOINS``): ``part`` first, because project, type and step, by which
most jobs filter, come from it. Orders find their customers before records find their
orders, so records are shuffled by part and by order only. Sites come last and one table at
a time: a join's estimated size is the product of its sides, so that sites put together
first would never be broadcast, however few they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BUCKET_LEVELS, BUCKET_VALUE

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_shipdate timestamp_ntz",
}

_RECORD = """
SELECT
  l.l_orderkey AS jeditaskid,
  CASE WHEN l.l_orderkey % 89 = 3 OR l.l_shipdate < TIMESTAMP '1995-02-01 00:00:00'
            OR l.l_shipdate > TIMESTAMP '2001-10-20 00:00:00' THEN NULL
       ELSE p.p_type || '.' || CAST(p.p_partkey AS STRING) END AS datasetname,
  CASE p.p_size % 4 WHEN 0 THEN 'mc16_13TeV' WHEN 1 THEN 'data18_13TeV'
                    WHEN 2 THEN 'data17_13TeV' ELSE 'mc15_5TeV' END AS ds_scope,
  CASE WHEN p.p_size % 5 = 0 THEN 'AOD' ELSE 'DAOD' END AS ds_data_type,
  p.p_type || CAST(p.p_size % 10 AS STRING) AS ds_data_type_desc,
  CASE WHEN p.p_size % 3 = 0 THEN 'merge' ELSE 'deriv' END AS ds_prod_step,
  (900 + p.p_partkey) * 1000000 AS ds_bytes,
  CASE WHEN l.l_orderkey % 17 = 0 THEN NULL
       ELSE CAST(1 + (l.l_partkey + l.l_orderkey) % 5 AS TINYINT) END AS ds_replicas_number,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL
       ELSE 'SITE_' || CAST(p.p_partkey % 7 AS STRING)
            || ',SITE_' || CAST(7 + p.p_partkey % 5 AS STRING)
            || ',' || s.s_name END AS ds_replicas_sites,
  CASE WHEN l.l_orderkey % 61 = 5 THEN NULL ELSE c.c_name END AS username,
  CASE WHEN c.c_nationkey = 3 THEN NULL
       ELSE 'INST_' || CAST(c.c_nationkey AS STRING) END AS institute_name,
  cn.n_name AS institute_country,
  s.s_name AS site_name,
  CASE WHEN s.s_suppkey % 50 = 7 THEN NULL ELSE r.r_name END AS site_cloud,
  CASE WHEN s.s_suppkey % 10 = 3 THEN 'ANALY_GPU'
       WHEN s.s_suppkey % 10 = 4 THEN NULL ELSE 'ANALY_CPU' END AS queue,
  CASE WHEN l.l_orderkey % 8 = 0 THEN 1 ELSE 0 END AS task_attemptnr,
  CASE WHEN l.l_linenumber = 7 THEN 'failed' ELSE 'finished' END AS jobstatus,
  CASE o.o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'done'
                       ELSE 'exhausted' END AS attempt_status,
  CASE o.o_orderstatus WHEN 'P' THEN 'failed' ELSE 'done' END AS task_status,
  CASE WHEN l.l_orderkey % 83 = 11 THEN NULL
       ELSE l.l_shipdate + ((l.l_orderkey * 7919 + l.l_linenumber * 104729) % 86400)
            * INTERVAL '1' SECOND END AS attempt_start,
  o.o_orderdate + ((l.l_orderkey * 31) % 86400) * INTERVAL '1' SECOND AS task_creationdate,
  l.l_shipdate + (3600 * l.l_linenumber + (l.l_orderkey * 7919) % 86400)
      * INTERVAL '1' SECOND AS task_modificationtime,
  CAST(l.l_quantity AS BIGINT) AS number_of_jobs,
  CASE WHEN l.l_linenumber = 6 THEN NULL
       ELSE (l.l_orderkey * 13 + l.l_partkey * 7) % 36000 END AS jobs_timetostart,
  (l.l_orderkey * 17 + l.l_partkey * 3) % 72000 AS jobs_total_duration,
  (l.l_orderkey * 19 + l.l_partkey * 5) % 64000 AS jobs_total_walltime,
  (l.l_orderkey * 23 + l.l_partkey * 11) % 60000 AS jobs_cpuconsumptiontime,
  1 + (l.l_orderkey * 29) % 180000 AS attempt_total_duration,
  (l.l_orderkey * 37) % 5400 AS attempt_ready_run_delay,
  (l.l_orderkey * 41) % 1800 AS attempt_pending_delta,
  (l.l_orderkey * 43) % 90000 AS attempt_running_delta,
  (l.l_orderkey * 47) % 2700 AS attempt_ready_delta,
  CAST((l.l_orderkey * 53) % 9000 AS DOUBLE) / 64 AS cpu_hours,
  (1 + l.l_partkey) * CAST(l.l_quantity AS BIGINT) * 1000000 AS jobs_total_inputfilebytes,
  (1 + l.l_suppkey) * CAST(l.l_quantity AS BIGINT) * 1000000 AS jobs_total_outputfilebytes,
  CAST(l.l_quantity AS BIGINT) * 10000000 AS jobs_primary_input_fsize,
  CAST(1 + s.s_suppkey % 3 AS INT) AS is_local
"""

_JOINS = """FROM {lineitem} l
JOIN {part} p   ON l.l_partkey = p.p_partkey
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN ({supplier} s JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey
                   JOIN {region} r ON sn.n_regionkey = r.r_regionkey)
  ON l.l_suppkey = s.s_suppkey
JOIN ({customer} c JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey)
  ON o.o_custkey = c.c_custkey
"""

ACCESS_LOG = _RECORD + _JOINS

SPARK_JOINS = """FROM {lineitem} l
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
                 JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey)
  ON l.l_orderkey = o.o_orderkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey
JOIN {region} r ON sn.n_regionkey = r.r_regionkey
"""

# The day the look-back reports are made, and the cut between an earlier and a
# later slice of the log.
AS_OF = "2001-06-01 00:00:00"
CUT = "2001-01-01 00:00:00"

SITE_VOLUME = """
SELECT s_name AS site_name, (1 + s_suppkey % 10) * 1000000000000 AS total_volume
FROM {supplier}
"""

SITE_ACCOUNTING = """
SELECT
  task_modificationtime AS timestamp, site_name AS site, ds_data_type AS datatype,
  ds_data_type_desc AS datatype_grouped, ds_prod_step AS prod_step, ds_scope AS scope,
  site_name || '_DISK' AS rse, username AS account, 'main' AS campaign,
  institute_country AS country, site_cloud AS cloud, 'derived' AS provenance,
  site_name AS experiment_site, 'physics' AS stream_name, '2' AS tier,
  'DATADISK' AS token,
  CASE WHEN ds_bytes % 7 = 0 THEN 'UNKNOWN' ELSE 'no' END AS tombstone, ds_bytes AS bytes
FROM {access_log}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per task attempt, dataset, queue, site and job status."""
    return spark.sql(_RECORD + SPARK_JOINS, **{name: table(spark, sf_dir, name) for name in TABLES})


def site_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITE_VOLUME, supplier=table(spark, sf_dir, "supplier"))


def accounting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SITE_ACCOUNTING, access_log=access_log(spark, sf_dir))


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def nest_buckets(flat: DataFrame, answer_levels: int = 2) -> DataFrame:
    """Flat accounting rows as nested answers, JSON text in ``answer``.

    There is one answer per site and type (the first ``answer_levels`` levels), so
    no answer gathers a whole site. Every list holds the keys of one level under
    one parent.
    """
    names = [name for _, name in BUCKET_LEVELS]
    field = BUCKET_VALUE
    df = flat.select(*names, F.struct(F.col("bytes").alias("value")).alias("inner"))
    for depth in reversed(range(len(names))):
        bucket = F.struct(F.col(names[depth]).alias("key"), F.col("inner").alias(field))
        field = BUCKET_LEVELS[depth][0]
        df = df.groupBy(*names[: max(depth, answer_levels)]).agg(
            F.struct(F.collect_list(bucket).alias("buckets")).alias("inner")
        )
    aggregations = F.struct(F.struct(F.col("inner").alias(field)).alias("aggregations"))
    return df.select(F.to_json(F.struct(F.array(aggregations).alias("responses"))).alias("answer"))
