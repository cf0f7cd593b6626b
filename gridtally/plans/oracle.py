"""Independent SQL for the registered queries.

Written from the definitions, not from the Spark plans: interval bounds are
spelled out and matched by range, rankings use window functions, outcomes sum
their differences one by one. Every text runs on the given tables.
"""

from __future__ import annotations

from . import fixtures
from .fixtures import AS_OF, CUT

LOG = fixtures.ACCESS_LOG.format(**{name: name for name in fixtures.TABLES})
GOOD = "task_attemptnr = 0 AND jobstatus = 'finished' AND attempt_status IN ('finished', 'done')"
DAOD = f"{GOOD} AND ds_data_type = 'DAOD'"
MC16 = f"{DAOD} AND ds_scope = 'mc16_13TeV'"
DERIV = f"{MC16} AND ds_prod_step = 'deriv'"
NO_GPU = f"{DAOD} AND (queue IS NULL OR NOT regexp_matches(queue, 'GPU|gpu'))"
USABLE = f"{NO_GPU} AND contains(ds_scope, '_13TeV')"


def sql(*steps: str) -> str:
    """The access log, the named steps after it, and the final select."""
    *named, last = steps
    return "WITH " + ",\n".join([f"access_log AS ({LOG})", *named]) + "\n" + last


def log(condition: str, name: str = "x") -> str:
    return f"{name} AS (SELECT * FROM access_log WHERE {condition})"


def slices(n: int, source: str = "x", time: str = "attempt_start", name: str = "slices") -> str:
    """The n half-open intervals between the first and the last record."""
    return f"""
{name} AS (
  SELECT k, lo + to_seconds(k * s // {n}) AS a,
         CASE WHEN k + 1 = {n} THEN hi ELSE lo + to_seconds((k + 1) * s // {n}) END AS z
  FROM (SELECT min({time}) AS lo, max({time}) AS hi,
               date_diff('second', min({time}), max({time})) AS s FROM {source}),
       range({n}) AS r(k))"""


def weight(n: int, newest: int = 0) -> str:
    """Recency weight of interval k; ``newest`` is the halving of the newest one."""
    return f"pow(2, -({n} - 1 - k + {newest}))"


def accesses(keys: str, source: str = "x", name: str = "acc", slices: str = "slices") -> str:
    return f"""
{name} AS (
  SELECT {keys}, k, count(DISTINCT jeditaskid) AS c
  FROM {source} JOIN {slices} ON attempt_start >= a AND attempt_start < z
  GROUP BY ALL)"""


def frequencies(n: int, newest: int = 0, names: str = "x", acc: str = "acc", out: str = "af") -> str:
    """Weighted accesses and accesses in the newest interval of every dataset."""
    return f"""
{out} AS (
  SELECT datasetname, coalesce(sum(c * {weight(n, newest)}), 0) AS w,
         coalesce(max(CASE WHEN k = {n - 1} THEN c END), 0) AS newest
  FROM (SELECT DISTINCT datasetname FROM {names} WHERE datasetname IS NOT NULL)
  LEFT JOIN {acc} USING (datasetname)
  GROUP BY datasetname)"""


def latest(source: str = "x", keys: str = "datasetname", name: str = "latest") -> str:
    return f"""
{name} AS (
  SELECT {keys}, CAST(ds_replicas_number AS INTEGER) AS replicas FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys}
      ORDER BY attempt_start DESC, ds_replicas_number DESC NULLS LAST) AS rn
    FROM {source} WHERE attempt_start IS NOT NULL) WHERE rn = 1)"""


def advice(af: str, latest: str, n: int) -> str:
    return f"""
SELECT datasetname, w / {n} AS "datasetAF", g AS "groupAF", replicas AS curr_n_replicas,
       round_even((w / {n}) / nullif(g, 0), 0) AS optimal_n_replicas,
       round_even((w / {n}) / nullif(g, 0), 0) - replicas AS decision,
       newest AS curr_n_accesses
FROM {af} LEFT JOIN {latest} USING (datasetname),
     (SELECT sum(w) / ({n} * count(*)) AS g FROM {af})"""


EXTRACT = [log(MC16), slices(8), accesses("datasetname"), frequencies(8), latest()]

PRIOR = [
    log(MC16),
    f"early AS (SELECT * FROM x WHERE attempt_start < TIMESTAMP '{CUT}')",
    f"late AS (SELECT * FROM x WHERE attempt_start >= TIMESTAMP '{CUT}')",
    slices(8, "early", name="early_slices"),
    accesses("datasetname", "early", "early_acc", "early_slices"),
    frequencies(8, names="early", acc="early_acc", out="early_af"),
    latest("early", name="early_latest"),
    f"prior AS ({advice('early_af', 'early_latest', 8)})",
]

A2 = [
    log(DERIV),
    slices(10),
    accesses("datasetname"),
    frequencies(10, newest=1),
    """
mean_latest AS (
  SELECT datasetname, avg(ds_replicas_number) AS replicas FROM (
    SELECT *, rank() OVER (PARTITION BY datasetname ORDER BY attempt_start DESC) AS rn FROM x)
  WHERE rn = 1 GROUP BY datasetname)""",
    """
freq AS (
  SELECT datasetname, replicas AS current_n_replicas, newest AS current_accesses,
         w / 10 AS ds_avg_access_frequency, g AS group_avg_access_frequency,
         round_even((w / 10) / nullif(g, 0), 0) AS optimal_replicas_number
  FROM af LEFT JOIN mean_latest USING (datasetname),
       (SELECT sum(w) / (10 * count(*)) AS g FROM af))""",
]


def shares(place: str, column: str) -> str:
    return sql(
        *A2,
        accesses(f"datasetname, {column}", name="pacc"),
        f"""
use AS (
  SELECT datasetname, {column} AS {place}, sum(c * {weight(10, 1)}) AS w
  FROM pacc WHERE {column} IS NOT NULL GROUP BY ALL HAVING sum(c) > 0)""",
        f"""
SELECT {place}, w / 10 AS weighted_accesses, datasetname, w / nullif(t, 0) AS x_{place}s,
       current_n_replicas, current_accesses, ds_avg_access_frequency,
       group_avg_access_frequency, optimal_replicas_number,
       round_even(optimal_replicas_number * (w / nullif(t, 0)), 0) AS n_replicas_at_{place}
FROM (SELECT *, sum(w) OVER (PARTITION BY datasetname) AS t FROM use)
JOIN freq USING (datasetname)""",
    )


def placement(place: str, column: str) -> str:
    return sql(
        *PRIOR,
        slices(10),
        accesses(f"datasetname, {column}", name="pacc"),
        f"""
use AS (
  SELECT datasetname, {column} AS {place}, sum(c * {weight(10)}) AS w
  FROM pacc WHERE {column} IS NOT NULL AND datasetname IS NOT NULL
  GROUP BY ALL HAVING sum(c) > 0)""",
        f"""
SELECT datasetname, t / 10 AS "datasetAF_all_{place}s", {place},
       w / 10 AS "datasetAF_{place}", "datasetAF", "groupAF", curr_n_replicas,
       optimal_n_replicas, decision, curr_n_accesses,
       round_even(optimal_n_replicas * (w / nullif(t, 0)), 0) AS replicas_at_{place}
FROM (SELECT *, sum(w) OVER (PARTITION BY datasetname) AS t FROM use)
LEFT JOIN prior USING (datasetname)""",
    )


PAIRS = "ds_scope, ds_data_type"
BY_PROJECT = sql(
    log(
        f"{GOOD} AND ds_data_type IN ('DAOD', 'AOD') "
        "AND ds_scope IN ('data16_13TeV', 'mc16_13TeV', 'data18_13TeV', 'data15_13TeV', "
        "'mc15_13TeV', 'data17_13TeV')"
    ),
    f"""
slices AS (
  SELECT {PAIRS}, k, lo + to_seconds(k * s // 8) AS a,
         CASE WHEN k = 7 THEN hi ELSE lo + to_seconds((k + 1) * s // 8) END AS z
  FROM (SELECT {PAIRS}, min(attempt_start) AS lo, max(attempt_start) AS hi,
               date_diff('second', min(attempt_start), max(attempt_start)) AS s
        FROM x GROUP BY ALL), range(8) AS r(k))""",
    f"""
acc AS (
  SELECT {PAIRS}, datasetname, k, count(DISTINCT username) AS c
  FROM x JOIN slices USING ({PAIRS}) WHERE attempt_start >= a AND attempt_start < z
  GROUP BY ALL)""",
    f"""
af AS (
  SELECT {PAIRS}, datasetname, coalesce(sum(c * {weight(8)}), 0) AS w
  FROM (SELECT DISTINCT {PAIRS}, datasetname FROM x
        WHERE datasetname IS NOT NULL AND attempt_start IS NOT NULL)
  LEFT JOIN acc USING ({PAIRS}, datasetname) GROUP BY ALL)""",
    latest(keys=f"{PAIRS}, datasetname"),
    f"""
SELECT {PAIRS}, datasetname, w / 8 AS "datasetAF", g AS "groupAF",
       replicas AS curr_n_replicas,
       round_even((w / 8) / nullif(g, 0), 0) AS optimal_n_replicas,
       round_even((w / 8) / nullif(g, 0), 0) - replicas AS decision
FROM af JOIN (SELECT {PAIRS}, sum(w) / (8 * count(*)) AS g FROM af GROUP BY ALL)
  USING ({PAIRS})
LEFT JOIN latest USING ({PAIRS}, datasetname)""",
)

# --- rolling advice -------------------------------------------------------------

T = "task_modificationtime"
ROLLING = [
    log(DERIV),
    f"span AS (SELECT min({T}) AS first, max({T}) AS last FROM x)",
    f"""
steps AS (
  SELECT j, first + to_seconds(j * 604800) AS a, first + to_seconds(j * 604800 + 5184000) AS z
  FROM span, range(0, 1000) AS r(j) WHERE first + to_seconds(j * 604800) < last)""",
    f"rows_of AS (SELECT j, a AS window_start, x.* FROM x JOIN steps ON {T} >= a AND {T} < z)",
    f"""
edges AS (
  SELECT j, window_start, min({T}) AS lo, max({T}) AS hi,
         date_diff('second', min({T}), max({T})) AS s FROM rows_of GROUP BY ALL)""",
    """
cuts AS (
  SELECT j, k, lo + to_seconds(k * s // 8) AS a,
         CASE WHEN k = 7 THEN hi ELSE lo + to_seconds((k + 1) * s // 8) END AS z
  FROM edges, range(8) AS r(k))""",
    f"""
acc AS (
  SELECT j, datasetname, k, count(DISTINCT jeditaskid) AS n, count(DISTINCT username) AS u
  FROM rows_of JOIN cuts USING (j) WHERE {T} >= cuts.a AND {T} < cuts.z GROUP BY ALL)""",
    f"""
sizes AS (
  SELECT datasetname, max(ds_bytes) / 1000000000.0::DOUBLE AS ds_size_GB FROM x
  WHERE datasetname IS NOT NULL GROUP BY ALL)""",
    f"""
per AS (
  SELECT j, datasetname,
         coalesce(sum(n * {weight(8)} * (1 / (1 + exp(5.0::DOUBLE - u)))), 0) / 8 AS af,
         coalesce(max(CASE WHEN k = 7 THEN n END), 0) AS n,
         coalesce(max(CASE WHEN k = 7 THEN u END), 0) AS u
  FROM sizes CROSS JOIN edges LEFT JOIN acc USING (j, datasetname) GROUP BY ALL)""",
    "grp AS (SELECT j, sum(af) / count(*) AS g FROM per GROUP BY j)",
    f"""
last_seen AS (
  SELECT j, datasetname, CAST(ds_replicas_number AS INTEGER) AS replicas FROM (
    SELECT *, row_number() OVER (PARTITION BY j, datasetname
      ORDER BY {T} DESC, ds_replicas_number DESC NULLS LAST) AS rn FROM rows_of)
  WHERE rn = 1)""",
    """
rolled AS (
  SELECT datasetname, af, g, replicas, n, u, ds_size_GB, hi, window_start,
         last_seen.j IS NOT NULL AS present, round_even(round(af / nullif(g, 0), 9), 0) AS o
  FROM per JOIN grp USING (j) JOIN edges USING (j) JOIN sizes USING (datasetname)
  LEFT JOIN last_seen USING (j, datasetname))""",
    """
weekly AS (
  SELECT datasetname, af AS "datasetAF", g AS "groupAF", replicas AS curr_n_replicas,
         n AS curr_n_accesses, u AS curr_n_users,
         CASE WHEN least(o, n) = 0 AND o IS NOT NULL THEN 1
              WHEN o > n THEN CAST(n AS DOUBLE) ELSE o END AS optimal_n_replicas,
         ds_size_GB AS "ds_size_GB", hi AS timestamp, window_start, present
  FROM rolled)""",
]

FILLED = """
filled AS (
  SELECT *, first_value(curr_n_replicas IGNORE NULLS) OVER (
      PARTITION BY datasetname ORDER BY timestamp, window_start
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled,
    row_number() OVER (PARTITION BY datasetname ORDER BY timestamp DESC, window_start DESC) AS rn,
    lag(optimal_n_replicas) OVER (
      PARTITION BY datasetname ORDER BY timestamp DESC, window_start DESC) AS newer,
    count(*) OVER (PARTITION BY datasetname) AS n
  FROM weekly)"""

OUTCOME = sql(
    *ROLLING,
    FILLED,
    """
summed AS (
  SELECT datasetname,
    max(CASE WHEN rn = 1 THEN optimal_n_replicas - filled END)
      + CASE WHEN max(n) < 3 THEN 0
             WHEN count(CASE WHEN rn >= 3 THEN optimal_n_replicas - newer END) < max(n) - 2
             THEN NULL
             ELSE sum(CASE WHEN rn >= 3 THEN optimal_n_replicas - newer END) END AS created,
    min(filled) AS least_r, max(CASE WHEN rn = 1 THEN "ds_size_GB" END) AS size,
    CAST(sum(curr_n_accesses) AS BIGINT) AS total_n_accesses, max(curr_n_users) AS total_n_users,
    CAST(max(filled) AS DOUBLE) AS replicas_created_real, avg("datasetAF") AS af
  FROM filled GROUP BY datasetname)""",
    """
decided AS (
  SELECT *, CASE WHEN created <= 0 OR created < least_r THEN CAST(least_r AS DOUBLE)
                 ELSE created END AS simul FROM summed)""",
    """
SELECT datasetname, simul AS replicas_created_simul, size AS "ds_size_GB", total_n_accesses,
       total_n_users, replicas_created_real, round(af, 8) AS "datasetAF",
       round(size * simul, 8) AS simul_created_volume,
       round(size * replicas_created_real, 8) AS real_created_volume
FROM decided""",
)

# --- reports ----------------------------------------------------------------------

LOOKBACKS = [("last_week", 7), ("last_month", 30), ("last_2_months", 60)]


def lookback_rows(labels) -> str:
    values = ", ".join(f"('{name}', {days})" for name, days in labels)
    return f"""
seen AS (
  SELECT lookback, days, x.* FROM x JOIN (VALUES {values}) AS l(lookback, days)
    ON task_modificationtime BETWEEN TIMESTAMP '{AS_OF}' - to_days(days) AND TIMESTAMP '{AS_OF}')"""


def wavg(column: str, unit: int = 60) -> str:
    return (
        f"CAST(sum({column} * number_of_jobs) AS DOUBLE) / nullif(CAST(sum(CASE WHEN {column} "
        f"IS NOT NULL THEN number_of_jobs END) AS DOUBLE), 0) / {unit}"
    )


ATTEMPT_FRACTION = "(CAST(jobs_total_duration AS DOUBLE) / nullif(attempt_total_duration, 0))"
DATASET_FRACTION = "(CAST(jobs_primary_input_fsize AS DOUBLE) / nullif(ds_bytes, 0))"
TIB, TB = 1099511627776, 1000000000000

REPORT = [
    ("Total Number of Jobs", "CAST(sum(number_of_jobs) AS DOUBLE)", "sum"),
    ("Jobs Waiting Time (minutes) per Task", wavg("jobs_timetostart"), "avg"),
    ("Jobs Execution Time (minutes) per Task", wavg("jobs_total_duration"), "avg"),
    ("Individual Analysis Users", "CAST(count(DISTINCT username) AS DOUBLE)", "max"),
    ("Jobs Walltime (minutes) per Task", wavg("jobs_total_walltime"), "avg"),
    ("Jobs CPU Time (minutes) per Task", wavg("jobs_cpuconsumptiontime"), "avg"),
    ("Fraction of Task Attempt Execution Time", wavg(ATTEMPT_FRACTION, 1), "avg"),
    ("Total Input Data (TB)", f"CAST(sum(jobs_total_inputfilebytes) AS DOUBLE) / {TIB}", "sum"),
    ("Total Output Data (TB)", f"CAST(sum(jobs_total_outputfilebytes) AS DOUBLE) / {TIB}", "sum"),
    (
        "Max Input Volume per Task (TB)",
        f"CAST(max(jobs_total_inputfilebytes) AS DOUBLE) / {TIB}",
        "max",
    ),
]

JOINED = [
    ("jobs_total_duration", wavg("jobs_total_duration"), "avg"),
    ("jobs_timetostart", wavg("jobs_timetostart"), "avg"),
    ("number_of_jobs", "CAST(sum(number_of_jobs) AS DOUBLE)", "sum"),
    ("fraction_of_dataset", wavg(DATASET_FRACTION, 1), "avg"),
    ("jobs_total_walltime", wavg("jobs_total_walltime"), "avg"),
    ("jobs_cpuconsumptiontime", wavg("jobs_cpuconsumptiontime"), "avg"),
    ("jobs_total_inputfilebytes", f"CAST(sum(jobs_total_inputfilebytes) AS DOUBLE) / {TB}", "sum"),
    (
        "jobs_total_outputfilebytes",
        f"CAST(sum(jobs_total_outputfilebytes) AS DOUBLE) / {TB}",
        "sum",
    ),
    ("fraction_of_attempt_duration", f"avg({ATTEMPT_FRACTION})", "avg"),
]


def site_step(metrics, keys: str, source: str) -> str:
    """Long site values, one select per metric."""
    parts = [
        f"SELECT {keys}, '{name}' AS metric, {value} AS v FROM {source} "
        f"WHERE site_cloud IS NOT NULL GROUP BY {keys}"
        for name, value, _ in metrics
    ]
    return "sites AS (" + "\nUNION ALL ".join(parts) + ")"


def cloud_value(metrics) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {how}(v)" for name, _, how in metrics)
    return f"CASE metric {cases} END"


def round_1(value: str) -> str:
    return f"round_even(({value}) * 10, 0) / 10"


def report_sql(metrics, prefix: list[str], source: str, *, clouds: bool, extra: str = "") -> str:
    step = site_step(metrics, f"{extra}ds_scope, site_cloud, site_name", source)
    if clouds:
        final = f"""
SELECT {extra}ds_scope, site_cloud, metric, {round_1('v')} AS value FROM (
  SELECT {extra}ds_scope, site_cloud, metric, {cloud_value(metrics)} AS v
  FROM sites GROUP BY {extra}ds_scope, site_cloud, metric) WHERE v IS NOT NULL"""
    else:
        final = f"""
SELECT {extra}ds_scope, site_cloud, site_name, metric, {round_1('v')} AS value
FROM sites WHERE v IS NOT NULL"""
    return sql(*prefix, step, final)


UTILISATION = [log(DAOD), lookback_rows(LOOKBACKS)]


def pivot_sql(value: str, by: str = "ds_scope") -> str:
    return sql(
        log(NO_GPU),
        f"""
sites AS (SELECT {by}, site_cloud, site_name, {value} AS v FROM x
          WHERE site_cloud IS NOT NULL AND {by} IS NOT NULL GROUP BY ALL)""",
        f"clouds AS (SELECT {by}, site_cloud, avg(v) AS v FROM sites GROUP BY ALL)",
        f"""
SELECT 'within_cloud' AS part, {by}, site_cloud, site_name, v AS value FROM sites
UNION ALL SELECT 'all_sites', {by}, site_cloud, site_name, v FROM sites
UNION ALL SELECT 'by_cloud', {by}, site_cloud, CAST(NULL AS VARCHAR), v FROM clouds""",
    )


def mean(column: str, unit: int = 1) -> str:
    value = f"CAST(sum({column}) AS DOUBLE) / nullif(CAST(count({column}) AS DOUBLE), 0)"
    return f"coalesce({value}{f' / {unit}' if unit != 1 else ''}, 0)"


QUEUE_SECONDS = (
    "((date_diff('second', attempt_start, task_creationdate) % 86400) + 86400) % 86400"
)

POPULARITY = sql(
    log(DAOD),
    lookback_rows([("Last Week", 7), ("Last Month", 30), ("Last 2 Months", 60)]),
    f"""
SELECT lookback, ds_scope, regexp_replace(ds_data_type_desc, '[0-9]+', '', 'g') AS
         ds_data_type_desc,
  count(DISTINCT jeditaskid) AS n_tasks, CAST(sum(number_of_jobs) AS BIGINT) AS n_jobs,
  count(DISTINCT username) AS n_users, count(DISTINCT institute_name) AS n_institutes,
  count(DISTINCT institute_country) AS n_countries,
  {mean('attempt_total_duration', 60)} AS "attempt_duration(min)",
  {mean('attempt_ready_run_delay')} AS "attempt_ready_run_delay(min)",
  {mean('attempt_pending_delta')} AS "attempt_pending(min)",
  {mean('attempt_running_delta')} AS "attempt_running(min)",
  {mean('attempt_ready_delta')} AS attempt_ready_delta,
  {mean(f'({QUEUE_SECONDS})', 60)} AS "queue_time(min)",
  count(DISTINCT site_name) AS n_sites, count(DISTINCT site_cloud) AS n_clouds,
  CAST(sum(jobs_total_inputfilebytes) AS DOUBLE) / {TIB} AS "input_TB",
  CAST(sum(jobs_total_outputfilebytes) AS DOUBLE) / {TIB} AS "output_TB",
  count(DISTINCT datasetname) AS n_datasets,
  {mean('ds_replicas_number')} AS replication_factor,
  strftime(TIMESTAMP '{AS_OF}' - to_days(days), '%Y-%m-%d') AS "TimestampStart",
  strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%d') AS "TimestampEnd"
FROM seen
GROUP BY lookback, days, ds_scope, regexp_replace(ds_data_type_desc, '[0-9]+', '', 'g')""",
)

# --- sites ------------------------------------------------------------------------

HELD = """
held AS (
  SELECT ds_replicas_sites, CAST(count(*) AS BIGINT) AS n_replicas,
         CAST(sum(b) AS DOUBLE) AS replicas_volume FROM (
    SELECT site AS ds_replicas_sites, datasetname, sum(ds_bytes) AS b FROM (
      SELECT datasetname, ds_bytes, unnest(string_split(ds_replicas_sites, ',')) AS site
      FROM (SELECT DISTINCT datasetname, ds_replicas_sites, ds_bytes FROM x
            WHERE ds_replicas_sites IS NOT NULL AND datasetname IS NOT NULL))
    GROUP BY ALL) GROUP BY ds_replicas_sites)"""

DONE = """
done AS (
  SELECT site_name, count(DISTINCT datasetname) AS n_datasets,
         CAST(sum(f) AS DOUBLE) AS processed_data_volume FROM (
    SELECT site_name, datasetname, coalesce(sum(f), 0) AS f FROM (
      SELECT DISTINCT site_name, datasetname, jobs_primary_input_fsize AS f FROM x
      WHERE datasetname IS NOT NULL)
    GROUP BY ALL) GROUP BY site_name)"""


INVENTORY = f"""
SELECT ds_replicas_sites, n_replicas, replicas_volume / {TB} AS replicas_volume, n_datasets,
       processed_data_volume / {TB} AS processed_data_volume
FROM held LEFT JOIN done ON ds_replicas_sites = site_name"""


def percent(part: str, total: str) -> str:
    return round_1(f"CAST({part} AS DOUBLE) / nullif(CAST({total} AS DOUBLE), 0) * 100")


LOCALITY = sql(
    log(USABLE),
    f"volume AS ({fixtures.SITE_VOLUME.format(supplier='supplier')})",
    """
parts AS (
  SELECT site_name, site_cloud, is_local, sum(ds_bytes) AS b FROM (
    SELECT DISTINCT datasetname, site_name, site_cloud, ds_bytes, is_local FROM x
    WHERE ds_replicas_sites IS NOT NULL AND site_cloud IS NOT NULL) GROUP BY ALL)""",
    """
flat AS (
  SELECT s.site_name, s.site_cloud, l.b AS l, r.b AS r, t.b AS t
  FROM (SELECT DISTINCT site_name, site_cloud FROM parts) s
  LEFT JOIN (SELECT * FROM parts WHERE is_local = 1) l USING (site_name, site_cloud)
  LEFT JOIN (SELECT * FROM parts WHERE is_local = 2) r USING (site_name, site_cloud)
  LEFT JOIN (SELECT * FROM parts WHERE is_local = 3) t USING (site_name, site_cloud))""",
    f"""
SELECT site_name, site_cloud, CAST(total_volume AS DOUBLE) / {TB} AS total_volume,
  CAST(l AS DOUBLE) / {TB} AS local_accessed, CAST(r AS DOUBLE) / {TB} AS remote_accessed,
  CAST(t AS DOUBLE) / {TB} AS "staged_in_from_TAPE",
  {percent('l', 'total_volume')} AS "local%", {percent('r', 'total_volume')} AS "remote%",
  {percent('t', 'total_volume')} AS "from_TAPE%",
  CAST(l + r + t AS DOUBLE) / {TB} AS total_accessed,
  {percent('l + r + t', 'total_volume')} AS "total_accessed%"
FROM volume LEFT JOIN flat USING (site_name)""",
)

DOCUMENTS = [
    f"docs AS ({fixtures.SITE_ACCOUNTING.format(access_log='access_log')})",
    """
good AS (
  SELECT * FROM docs
  WHERE account IS NOT NULL AND campaign IS NOT NULL AND country IS NOT NULL
    AND cloud IS NOT NULL AND datatype IS NOT NULL AND datatype_grouped IS NOT NULL
    AND prod_step IS NOT NULL AND provenance IS NOT NULL AND rse IS NOT NULL
    AND scope IS NOT NULL AND experiment_site IS NOT NULL AND stream_name IS NOT NULL
    AND tier IS NOT NULL AND token IS NOT NULL AND tombstone IS NOT NULL
    AND tombstone <> 'UNKNOWN' AND rse NOT LIKE '%none%'
    AND timestamp BETWEEN TIMESTAMP '1999-03-01 00:00:00' AND TIMESTAMP '2001-03-02 00:00:00')""",
]


def accounting(keep: int | None = None) -> str:
    levels = ["site", "datatype", "datatype_grouped", "prod_step", "scope"]
    steps, source = [], "good"
    for depth, level in enumerate(levels if keep else []):
        parents = ", ".join(levels[:depth])
        partition = f"PARTITION BY {parents} " if parents else ""
        steps.append(
            f"""
top_{depth} AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, dense_rank() OVER ({partition}ORDER BY {level} DESC) AS r FROM {source})
  WHERE r <= {keep})"""
        )
        source = f"top_{depth}"
    return sql(
        *DOCUMENTS,
        *steps,
        f"""
SELECT TIMESTAMP '1999-03-01 00:00:00' AS datetime, site, datatype,
       datatype_grouped AS datatypeg, prod_step AS prodstep, scope,
       CAST(sum(bytes) AS DOUBLE) AS bytes
FROM {source} GROUP BY ALL""",
    )


RECORD = (
    "jeditaskid, datasetname, site_name, queue, attempt_start, number_of_jobs, ds_replicas_sites"
)
BATCH = f"{T} >= TIMESTAMP '{CUT}'"
UPSERT = sql(
    f"""
SELECT {RECORD} FROM access_log
WHERE {BATCH} OR jeditaskid NOT IN (SELECT jeditaskid FROM access_log WHERE {BATCH})""",
)

REJECTS = sql(
    """
SELECT CASE WHEN k > 1 THEN jeditaskid END AS jeditaskid, CASE WHEN k > 1 THEN datasetname END AS datasetname,
  CASE WHEN k > 2 THEN number_of_jobs END AS number_of_jobs,
  CASE k WHEN 0 THEN head || ',' || CAST(number_of_jobs AS VARCHAR) || ',more' WHEN 1 THEN head || ',' || site_name END AS text,
  CASE k WHEN 0 THEN '4 fields instead of 3' WHEN 1 THEN 'number_of_jobs is no bigint' END AS reason
FROM (SELECT *, jeditaskid % 6 AS k, CAST(jeditaskid AS VARCHAR) || ',' || coalesce(datasetname, '') AS head FROM access_log)"""
)

DASHBOARD = [log(USABLE)]
CLOUD_NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def wide_report() -> str:
    cells = ", ".join(
        f"max(CASE WHEN site_cloud = '{c}' THEN value END) AS \"{c}\"" for c in CLOUD_NAMES
    )
    long = report_sql(REPORT, DASHBOARD, "x", clouds=True)
    return f"SELECT ds_scope, metric, {cells} FROM ({long}) GROUP BY ds_scope, metric"


SINGLE = sql(
    log(GOOD),
    "SELECT datasetname, site_cloud, site_name, "
    + ", ".join(
        (f"round({value}, 9)" if name.startswith("Fraction") else value) + f' AS "{name}"'
        for name, value, _ in REPORT
    )
    + " FROM x WHERE site_cloud IS NOT NULL AND datasetname IS NOT NULL "
    "GROUP BY datasetname, site_cloud, site_name",
)

JOBS_SUM = "CAST(sum(number_of_jobs) AS DOUBLE)"
PART = f"CASE WHEN {T} < first + to_days(1200) THEN 'train' ELSE 'validate' END AS part"
FIRST = f"(SELECT min({T}) AS first FROM x)"
MARCH = "TIMESTAMP '2001-03-15 00:00:00'"

ORACLE_SQL: dict[str, str] = {
    "replication_advice": sql(*EXTRACT, advice("af", "latest", 8)),
    "interval_access": sql(
        log(DERIV),
        slices(10),
        accesses("datasetname"),
        f"""
SELECT d.datasetname, s.a AS timestamp, {weight(10, 1)} AS weight,
       coalesce(c, 0) AS n_accesses, coalesce(c, 0) * {weight(10, 1)} AS weighted_accesses
FROM (SELECT DISTINCT datasetname FROM x WHERE datasetname IS NOT NULL) d CROSS JOIN slices s
LEFT JOIN acc USING (datasetname, k)""",
    ),
    "dataset_frequency": sql(*A2, "SELECT * FROM freq"),
    "cloud_shares": shares("cloud", "site_cloud"),
    "site_shares": shares("site", "site_name"),
    "placement_cloud": placement("cloud", "site_cloud"),
    "placement_site": placement("site", "site_name"),
    "advice_by_project": BY_PROJECT,
    "frequency_for_list": sql(
        *PRIOR[:3],
        slices(8, "late"),
        accesses("datasetname", "late"),
        frequencies(8, names="early"),
        """
SELECT datasetname, w / 8 AS "new_datasetAF", g AS "new_groupAF"
FROM af, (SELECT sum(w) / (8 * count(*)) AS g FROM af)""",
    ),
    "next_period_validation": sql(
        *PRIOR,
        "nxt AS (SELECT datasetname, count(DISTINCT jeditaskid) AS c FROM late GROUP BY ALL)",
        """
SELECT prior.*, c AS next_week_accesses,
       coalesce(c - curr_n_accesses > 0 AND decision > 0, FALSE) AS validator
FROM prior LEFT JOIN nxt USING (datasetname)""",
    ),
    "train_split": sql(
        log(MC16), f"SELECT {PART}, datasetname, jeditaskid, {T} FROM x, {FIRST}"
    ),
    "split_sizes": sql(
        log(MC16),
        f"""
SELECT part, count(*) AS n_records, count(DISTINCT datasetname) AS n_datasets
FROM (SELECT {PART}, datasetname FROM x, {FIRST}) GROUP BY part""",
    ),
    "most_popular": sql(
        """
SELECT datasetname, count(DISTINCT jeditaskid) AS n_tasks FROM access_log
WHERE datasetname IS NOT NULL GROUP BY datasetname ORDER BY n_tasks DESC, datasetname LIMIT 500"""
    ),
    "popular_records": sql(
        """
top AS (SELECT datasetname FROM access_log WHERE datasetname IS NOT NULL GROUP BY datasetname
        ORDER BY count(DISTINCT jeditaskid) DESC, datasetname LIMIT 500)""",
        f"""
SELECT datasetname, count(*) AS n_records, CAST(sum(number_of_jobs) AS BIGINT) AS n_jobs
FROM access_log WHERE {GOOD} AND datasetname IN (FROM top) GROUP BY datasetname""",
    ),
    "multi_user_records": sql(
        log(DERIV),
        """
SELECT datasetname, jeditaskid, username FROM x WHERE datasetname IN (
  SELECT datasetname FROM x GROUP BY datasetname HAVING count(DISTINCT username) > 1)""",
    ),
    "weights_all_schemes": sql(
        log(MC16),
        slices(10),
        accesses("datasetname"),
        f"""
SELECT a AS timestamp, CAST(c AS BIGINT) AS n_accesses, CAST(k AS INTEGER) AS i,
       round(c * {weight(10)}, 9) AS newest_one, round(c * {weight(10, 1)}, 9) AS newest_half,
       round(c * (k + 1) / 11.0::DOUBLE, 9) AS linear,
       round(c * exp(-(k + 1) / 11.0::DOUBLE), 9) AS exponential
FROM slices JOIN (SELECT k, sum(c) AS c FROM acc GROUP BY k) USING (k)""",
    ),
    "rolling_advice": sql(
        *ROLLING,
        """
SELECT * EXCLUDE (present)
  REPLACE (round("datasetAF", 8) AS "datasetAF", round("groupAF", 8) AS "groupAF")
FROM weekly WHERE present""",
    ),
    "advice_outcome": OUTCOME,
    "backfill": sql(
        *ROLLING,
        FILLED,
        "SELECT datasetname, window_start, curr_n_replicas, filled FROM filled WHERE present",
    ),
    "utilisation_sites": report_sql(
        REPORT, UTILISATION, "seen", clouds=False, extra="lookback, "
    ),
    "utilisation_from_states": report_sql(
        REPORT, UTILISATION, "seen", clouds=False, extra="lookback, "
    ),
    "utilisation_clouds": report_sql(REPORT, UTILISATION, "seen", clouds=True, extra="lookback, "),
    "dashboard_sites": report_sql(REPORT, DASHBOARD, "x", clouds=False),
    "dashboard_clouds": report_sql(REPORT, DASHBOARD, "x", clouds=True),
    "dashboard_wide": wide_report(),
    "joined_sites": report_sql(JOINED, DASHBOARD, "x", clouds=False),
    "joined_clouds": report_sql(JOINED, DASHBOARD, "x", clouds=True),
    "strict_pivot_check": sql(
        log(USABLE),
        """
SELECT ds_scope, datasetname, site_name, count(*) AS count FROM x
GROUP BY ALL HAVING count(*) > 1""",
    ),
    "report_quantiles": sql(
        *UTILISATION,
        """
cells AS (
  SELECT lookback, ds_scope, site_cloud, site_name,
         quantile_cont(jobs_timetostart, 0.5) AS median, quantile_cont(jobs_timetostart, 0.9) AS q90,
         CAST(min(jobs_timetostart) AS DOUBLE) AS min, CAST(max(jobs_timetostart) AS DOUBLE) AS max,
         CAST(count(jobs_timetostart) AS DOUBLE) AS count
  FROM seen WHERE site_cloud IS NOT NULL GROUP BY ALL)""",
        " UNION ALL ".join(
            f"SELECT lookback, ds_scope, site_cloud, site_name, '{how}' AS metric, "
            f"round({how}, 6) AS value FROM cells WHERE {how} IS NOT NULL"
            for how in ("median", "q90", "min", "max", "count")
        ),
    ),
    "report_fractional": sql(
        log(USABLE),
        f"""
SELECT ds_scope, site_cloud, site_name, round(sum(cpu_hours), 9) AS sum,
       round({wavg('cpu_hours', 1)}, 9) AS wavg, round(avg(cpu_hours), 9) AS mean, max(cpu_hours) AS max
FROM x WHERE site_cloud IS NOT NULL GROUP BY ds_scope, site_cloud, site_name""",
    ),
    "declared_read": sql(
        """
SELECT jeditaskid, datasetname, site_name, attempt_start, ds_replicas_number, number_of_jobs
FROM access_log"""
    ),
    "metric_pivot": pivot_sql(JOBS_SUM),
    "metric_pivot_unsplit": sql(
        log(NO_GPU),
        f"SELECT ds_scope, site_name, {JOBS_SUM} AS value FROM x GROUP BY ds_scope, site_name",
    ),
    "metric_pivot_datasets": pivot_sql("CAST(max(number_of_jobs) AS DOUBLE)", by="datasetname"),
    "metric_pivot_median": pivot_sql("median(jobs_timetostart)"),
    "metric_pivot_wavg": "SELECT * REPLACE (round(value, 9) AS value) FROM ("
    + pivot_sql(wavg("jobs_timetostart", 1))
    + ")",
    "single_dataset_wide": SINGLE,
    "overall_popularity": POPULARITY,
    "popularity_from_states": POPULARITY,
    "task_execution": sql(
        f"""
SELECT datasetname, jeditaskid, institute_name, task_status, ds_replicas_sites, site_name,
       jobstatus, CAST(sum(number_of_jobs) AS BIGINT) AS number_of_jobs
FROM access_log
WHERE {T} BETWEEN {MARCH} AND TIMESTAMP '2001-04-15 00:00:00' AND ds_replicas_sites IS NOT NULL
  AND datasetname IS NOT NULL AND institute_name IS NOT NULL
GROUP BY ALL"""
    ),
    "task_execution_of_dataset": sql(
        """
SELECT jeditaskid, institute_name, task_status, ds_replicas_sites, site_name,
       jobstatus, CAST(sum(number_of_jobs) AS BIGINT) AS number_of_jobs
FROM access_log
WHERE datasetname = (SELECT min(datasetname) FROM access_log)
  AND ds_replicas_sites IS NOT NULL AND institute_name IS NOT NULL
GROUP BY ALL"""
    ),
    "bounded_search": sql(
        f"""
SELECT jeditaskid, datasetname, site_name, jobstatus, number_of_jobs FROM access_log
WHERE {T} BETWEEN {MARCH} AND TIMESTAMP '{AS_OF}' ORDER BY ALL LIMIT 1000"""
    ),
    "document_scan": sql(
        f"""
SELECT jeditaskid, datasetname, username, site_name, ds_bytes FROM access_log
WHERE {DAOD} AND {T} BETWEEN {MARCH} AND TIMESTAMP '{AS_OF}'"""
    ),
    "log_table": sql(
        f"""
SELECT jeditaskid, datasetname, site_name, {T}, ds_bytes FROM access_log
WHERE {T} BETWEEN {MARCH} AND TIMESTAMP '{AS_OF}'"""
    ),
    "training_extract": sql(
        f"""
SELECT jeditaskid, datasetname, ds_data_type_desc, site_name, queue FROM access_log
WHERE {MC16} AND ds_data_type_desc LIKE '%PROMO%'
  AND NOT regexp_matches(datasetname, 'debug|hlt|scout|calib')"""
    ),
    "subset_extract": sql(
        """
SELECT datasetname, ds_replicas_number, attempt_total_duration, ds_bytes, jeditaskid,
       attempt_ready_run_delay, attempt_ready_delta, site_name, site_cloud,
       jobs_primary_input_fsize, jobs_timetostart, jobs_total_duration, number_of_jobs,
       attempt_start, jobs_total_inputfilebytes, jobs_total_outputfilebytes
FROM access_log
WHERE ds_data_type = 'DAOD' AND ds_data_type_desc = 'PROMO4' AND ds_prod_step = 'deriv'
  AND ds_scope = 'mc16_13TeV' AND task_attemptnr = 0 AND jobstatus = 'finished'
  AND attempt_status = 'done'"""
    ),
    "replica_inventory": sql(log(USABLE), HELD, "SELECT * FROM held"),
    "processed_by_site": sql(log(USABLE), DONE, "SELECT * FROM done"),
    "inventory_and_processing": sql(log(USABLE), HELD, DONE, INVENTORY),
    "inventory_top": sql(
        log(USABLE),
        HELD,
        DONE,
        f"{INVENTORY} ORDER BY n_replicas DESC, ds_replicas_sites LIMIT 50",
    ),
    "storage_locality": LOCALITY,
    "is_local_flag": sql(
        log(USABLE),
        """
SELECT site_name, list_contains(string_split(ds_replicas_sites, ','), site_name) AS local,
       count(*) AS n_records FROM x GROUP BY ALL""",
    ),
    "site_accounting": accounting(),
    "site_accounting_top": accounting(3),
    "bucket_flatten": accounting(),
    "bucket_files": f"SELECT site, sum(bytes) AS bytes FROM ({accounting()}) GROUP BY site",
    "csv_union": sql(
        """
SELECT jeditaskid, datasetname, site_name,
       CASE WHEN jobstatus = 'finished' THEN queue END AS queue,
       attempt_start, number_of_jobs, ds_replicas_sites FROM access_log"""
    ),
    "csv_scan": sql(f"SELECT {RECORD} FROM access_log"),
    "csv_bad_lines": sql(
        """
SELECT jeditaskid, number_of_jobs, datasetname FROM access_log
WHERE jobstatus <> 'failed' AND jeditaskid % 7 <> 0"""
    ),
    "csv_rejects": REJECTS,
    "hourly_rejects": REJECTS,
    "clustered_lookup": sql(
        f"""
SELECT jeditaskid, datasetname, site_name, task_modificationtime, number_of_jobs FROM access_log
WHERE datasetname = (SELECT min(datasetname) FROM access_log)
  AND {T} BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'"""
    ),
    "upsert_by_task": UPSERT,
    "hourly_batches": UPSERT,
    "replace_stored": UPSERT,
    "replace_stored_fewer": sql(
        f"""
SELECT {RECORD.replace("number_of_jobs", f"CASE WHEN NOT ({BATCH}) THEN number_of_jobs END AS number_of_jobs")} FROM access_log
WHERE {BATCH} OR jeditaskid NOT IN (SELECT jeditaskid FROM access_log WHERE {BATCH})"""
    ),
    "keyed_twice": sql(
        f"""
SELECT jeditaskid, datasetname, queue, number_of_jobs, site_name FROM (
  SELECT *, row_number() OVER (
    PARTITION BY jeditaskid, datasetname, {T}, task_attemptnr, queue, jobstatus
    ORDER BY number_of_jobs DESC, site_name DESC) AS rn FROM access_log) WHERE rn = 1"""
    ),
    "stream_late": sql(
        f"""
SELECT DISTINCT {RECORD.replace("number_of_jobs", "number_of_jobs + 100 * (jeditaskid % 4) AS number_of_jobs")}
FROM access_log"""
    ),
    "hourly_compacted": sql(
        f"""
SELECT {RECORD} FROM (
  SELECT *, max(part) OVER (PARTITION BY jeditaskid) AS newest FROM (
    SELECT *, CASE WHEN {T} < TIMESTAMP '1999-01-01 00:00:00' THEN 0
                   WHEN {T} < TIMESTAMP '{CUT}' THEN 1 ELSE 2 END AS part FROM access_log))
WHERE part = newest"""
    ),
    "nested_text": sql(
        """
SELECT jeditaskid,
  CASE WHEN jobstatus = 'failed' THEN NULL WHEN jeditaskid % 3 = 0 THEN site_name
       WHEN jeditaskid % 3 = 1 THEN 'the "big" (None) ' || site_name
       ELSE 'O''' || site_name END AS site,
  CASE WHEN jobstatus <> 'failed' AND jeditaskid % 3 <> 1 THEN number_of_jobs END AS n,
  CASE WHEN jobstatus = 'failed' OR jeditaskid % 3 = 2 THEN NULL ELSE jeditaskid % 3 = 0 END AS disk,
  CASE WHEN jobstatus = 'failed' THEN '[{''site''' END AS unread
FROM access_log"""
    ),
    "nested_misfits": sql(
        """
SELECT jeditaskid,
  CASE WHEN k IN (3, 4) THEN n END AS a, CASE WHEN k IN (2, 4) THEN site END AS b, misfit AS unread,
  CASE WHEN k IN (3, 4) THEN n END AS list_a, CASE WHEN k IN (2, 4) THEN site END AS list_b,
  '[{''a'': 7},' || misfit || ',]' AS list_unread
FROM (SELECT jeditaskid, jeditaskid % 5 AS k, number_of_jobs AS n, site_name AS site,
    CASE jeditaskid % 5
      WHEN 0 THEN '{''a'': ' || CAST(number_of_jobs AS VARCHAR) || ', ''b'': ''' || site_name
      WHEN 1 THEN '{''a'': ''' || site_name || '''}'
      WHEN 2 THEN '{''a'': ' || CAST(number_of_jobs AS VARCHAR) || '.5, ''b'': ''' || site_name || '''}'
      WHEN 3 THEN '{''a'': ' || CAST(number_of_jobs AS VARCHAR) || ', ''c'': ''' || site_name || '''}'
      END AS misfit
  FROM access_log) made"""
    ),
    "doc_id_dedup": sql(
        f"""
SELECT jeditaskid, datasetname, queue, number_of_jobs, site_name FROM (
  SELECT *, row_number() OVER (
    PARTITION BY jeditaskid, datasetname, {T}, task_attemptnr, queue, jobstatus
    ORDER BY number_of_jobs DESC, site_name DESC) AS rn FROM access_log) WHERE rn = 1"""
    ),
    "document_ids": sql(
        """
SELECT jeditaskid, datasetname, jobstatus,
       sha256(concat_ws(chr(1), CAST(jeditaskid AS VARCHAR),
         coalesce(datasetname, chr(0)), jobstatus)) AS doc_id
FROM access_log"""
    ),
    "json_records": sql(
        """
SELECT '{"jeditaskid":' || CAST(jeditaskid AS VARCHAR)
       || coalesce(',"datasetname":"' || datasetname || '"', '') || coalesce(',"queue":"' || queue || '"', '') || '}' AS doc FROM access_log"""
    ),
    "report_sheets": (
        "SELECT *, 'dashboard' AS report FROM ("
        + report_sql(REPORT, DASHBOARD, "x", clouds=False)
        + ")"
    ),
    "advice_fan_out": BY_PROJECT,
    "queue_time": sql(
        f"SELECT jeditaskid, datasetname, ({QUEUE_SECONDS}) / 60.0::DOUBLE AS queue_time "
        "FROM access_log"
    ),
    "text_times": sql("SELECT jeditaskid, attempt_start FROM access_log"),
    "time_slice": sql(
        f"""
SELECT jeditaskid, attempt_start FROM access_log
WHERE attempt_start >= TIMESTAMP '{CUT}' AND attempt_start < TIMESTAMP '{AS_OF}'"""
    ),
    "strip_digits": sql(
        """
SELECT regexp_replace(ds_data_type_desc, '[0-9]+', '', 'g') AS ds_data_type_desc,
       count(*) AS n_records FROM access_log GROUP BY 1"""
    ),
    "unit_conversion": sql(
        f"""
SELECT jeditaskid, CAST(jobs_total_duration AS DOUBLE) / 60 AS minutes,
       CAST(jobs_total_inputfilebytes AS DOUBLE) / {TIB} AS input_tib,
       CAST(jobs_total_inputfilebytes AS DOUBLE) / {TB} AS input_tb,
       CAST(jobs_total_outputfilebytes AS DOUBLE) / 1000000000 AS output_gb,
       {DATASET_FRACTION} AS fraction_of_dataset, {ATTEMPT_FRACTION} * 60 AS fraction_60
FROM access_log"""
    ),
    "weighted_average": sql(
        f"""
SELECT site_cloud, ds_scope, {wavg('jobs_timetostart', 1)} AS wavg_wait
FROM access_log WHERE site_cloud IS NOT NULL GROUP BY ALL"""
    ),
    "median_p90": sql(
        """
SELECT site_cloud, ds_scope, quantile_cont(jobs_timetostart, 0.5) AS median,
       round(quantile_cont(jobs_timetostart, 0.9), 6) AS q90
FROM access_log WHERE site_cloud IS NOT NULL GROUP BY ALL"""
    ),
    "round_to_base": sql(
        """
SELECT CAST(5 * round_even(number_of_jobs / 5.0::DOUBLE, 0) AS BIGINT) AS rounded,
       CAST(10 * round_even(jobs_timetostart / 60.0::DOUBLE / 10, 0) AS BIGINT) AS wait_tens,
       count(*) AS n_records FROM access_log GROUP BY ALL"""
    ),
    "rename_and_constants": sql(
        f"""
SELECT jeditaskid, number_of_jobs AS n_jobs, username AS user, '{AS_OF[:10]}' AS report_date
FROM access_log WHERE {DAOD}"""
    ),
}

# From stored profiles come the rows of the jobs over the log.
ORACLE_SQL |= {
    "stored_frequency": ORACLE_SQL["dataset_frequency"],
    "stored_cloud_shares": ORACLE_SQL["cloud_shares"],
    "stored_site_shares": ORACLE_SQL["site_shares"],
    "stored_placement": ORACLE_SQL["placement_site"],
}
