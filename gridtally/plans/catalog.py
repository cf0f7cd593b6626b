"""The registered queries: each job on the tables derived from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import gridtally as gt

from ..functions import intervals, measures, predicates, scalars
from ..operators import extracts, frequency, overview, profiles, utilisation
from ..operators.rolling import backfill as fill_back
from ..operators.validation import split_label
from ..schema import ACCESS_LOG_DDL, bucket_tree_ddl, declared_schema
from ..sources import files, keyed, sinks, upsert, workspace
from ..streaming import extracts as extracts_stream
from ..streaming import hourly
from . import fixtures
from .fixtures import AS_OF, CUT, access_log, moment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROJECT, DATA_TYPE, STEP = "mc16_13TeV", "DAOD", "deriv"
ADVICE_COLUMNS = """
datasetname jeditaskid username attempt_start task_modificationtime
ds_replicas_number ds_bytes site_name site_cloud
""".split()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _extract(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The filtered extract the frequency jobs start from."""
    options = {"data_type": DATA_TYPE, "project": PROJECT, **options}
    log = access_log(spark, sf_dir)
    return gt.prepared_extract(log, ADVICE_COLUMNS, **options)


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the dashboard reports."""
    return predicates.quality_filter(
        access_log(spark, sf_dir), data_type=DATA_TYPE, exclude_gpu=True, only_13tev=True
    )


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Doubles whose sums depend on row order, cut to comparable digits."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


# --- frequency and advice -----------------------------------------------------


@query
def replication_advice(spark, sf_dir):
    return gt.replication_advice(_extract(spark, sf_dir))


@query
def interval_access(spark, sf_dir):
    return gt.interval_access(_extract(spark, sf_dir, prod_step=STEP))


@query
def dataset_frequency(spark, sf_dir):
    return gt.dataset_frequency(_extract(spark, sf_dir, prod_step=STEP))


@query
def cloud_shares(spark, sf_dir):
    return gt.place_shares(_extract(spark, sf_dir, prod_step=STEP), "cloud")


@query
def site_shares(spark, sf_dir):
    return gt.place_shares(_extract(spark, sf_dir, prod_step=STEP), "site")


def _prior(extract: DataFrame) -> DataFrame:
    """Advice made at the cut, from the records before it."""
    return gt.replication_advice(extract.where(F.col("attempt_start") < moment(CUT)))


@query
def placement_cloud(spark, sf_dir):
    extract = _extract(spark, sf_dir)
    return gt.placement(extract, _prior(extract), "cloud")


@query
def placement_site(spark, sf_dir):
    extract = _extract(spark, sf_dir)
    return gt.placement(extract, _prior(extract), "site")


def _stored_profiles(spark: SparkSession, extract: DataFrame) -> str:
    name = f"profiles_{uuid.uuid4().hex}"
    profiles.write_profiles(extract, name, buckets=8)
    return name


@query
def stored_frequency(spark, sf_dir):
    """Dataset frequency from stored profiles."""
    return profiles.stored_frequency(spark, _stored_profiles(spark, _extract(spark, sf_dir, prod_step=STEP)))


@query
def stored_cloud_shares(spark, sf_dir):
    return profiles.stored_shares(spark, _stored_profiles(spark, _extract(spark, sf_dir, prod_step=STEP)), "cloud")


@query
def stored_site_shares(spark, sf_dir):
    return profiles.stored_shares(spark, _stored_profiles(spark, _extract(spark, sf_dir, prod_step=STEP)), "site")


@query
def stored_placement(spark, sf_dir):
    """Placement at sites from stored profiles and stored advice."""
    extract = _extract(spark, sf_dir)
    name = _stored_profiles(spark, extract)
    profiles.store_by_dataset(_prior(extract), f"{name}_advice", buckets=8)
    return profiles.stored_placement(spark, name, spark.table(f"{name}_advice"), "site")


def _by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = predicates.quality(data_type=frequency.DATA_TYPES, project=frequency.PROJECTS)
    log = access_log(spark, sf_dir).where(wanted)
    columns = [
        "ds_scope", "ds_data_type", "task_attemptnr", "jobstatus", "attempt_status",
        "datasetname", "username", "attempt_start", "ds_replicas_number",
    ]
    return gt.advice_by_project(log.select(*columns))


@query
def advice_by_project(spark, sf_dir):
    return _by_project(spark, sf_dir)


@query
def frequency_for_list(spark, sf_dir):
    extract = _extract(spark, sf_dir)
    before = extract.where(F.col("attempt_start") < moment(CUT))
    after = extract.where(F.col("attempt_start") >= moment(CUT))
    return gt.frequency_for_list(after, before.select("datasetname"))


@query
def next_period_validation(spark, sf_dir):
    extract = _extract(spark, sf_dir)
    after = extract.where(F.col("attempt_start") >= moment(CUT))
    return gt.next_period_validation(_prior(extract), after)


@query
def train_split(spark, sf_dir):
    extract = _extract(spark, sf_dir)
    rows = ["datasetname", "jeditaskid", "task_modificationtime"]
    train, validate = gt.train_split(extract, days=1200)
    return train.select(F.lit("train").alias("part"), *rows).unionByName(
        validate.select(F.lit("validate").alias("part"), *rows)
    )


@query
def split_sizes(spark, sf_dir):
    extract = _extract(spark, sf_dir)
    label = split_label(extract, days=1200).alias("part")
    return extract.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_records"), F.countDistinct("datasetname").alias("n_datasets")
    )


@query
def most_popular(spark, sf_dir):
    return gt.most_popular(access_log(spark, sf_dir), "datasetname", 500)


@query
def popular_records(spark, sf_dir):
    log = access_log(spark, sf_dir)
    popular = gt.most_popular(log, "datasetname", 500)
    kept = gt.keep_popular(log.where(predicates.first_good_attempt()), "datasetname", popular)
    return kept.groupBy("datasetname").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("number_of_jobs").alias("n_jobs")
    )


@query
def multi_user_records(spark, sf_dir):
    return gt.multi_user(_extract(spark, sf_dir, prod_step=STEP)).select(
        "datasetname", "jeditaskid", "username"
    )


@query
def weights_all_schemes(spark, sf_dir):
    extract, n = _extract(spark, sf_dir), 10
    bounds = intervals.time_bounds(extract, "attempt_start")
    profile = frequency.access_profile(
        extract, bounds, n, keys=["datasetname"], time_col="attempt_start", count_col="jeditaskid"
    )
    totals = profile.agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in range(n)])
    rows = [
        F.struct(
            F.lit(k).alias("i"),
            intervals.interval_start(k, bounds, n).alias("timestamp"),
            F.col(f"n_{k}").alias("n_accesses"),
            *[
                F.round(F.col(f"n_{k}") * intervals.recency_weight(k, n, scheme), 9).alias(scheme)
                for scheme in intervals.WEIGHT_SCHEMES
            ],
        )
        for k in range(n)
    ]
    return totals.select(F.inline(F.array(*rows)))


# --- rolling advice -------------------------------------------------------------


def _rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.rolling_advice(_extract(spark, sf_dir, prod_step=STEP))


@query
def rolling_advice(spark, sf_dir):
    return _rounded(_rolling(spark, sf_dir), "datasetAF", "groupAF", digits=8)


@query
def advice_outcome(spark, sf_dir):
    extract = _extract(spark, sf_dir, prod_step=STEP)
    return _rounded(
        gt.advice_outcome(gt.rolling_advice(extract), gt.rolling_calendar(extract)),
        "datasetAF",
        "simul_created_volume",
        "real_created_volume",
        digits=8,
    )


@query
def backfill(spark, sf_dir):
    newest_first = Window.partitionBy("datasetname").orderBy(
        F.desc("timestamp"), F.desc("window_start")
    )
    return _rolling(spark, sf_dir).select(
        "datasetname",
        "window_start",
        "curr_n_replicas",
        fill_back("curr_n_replicas", newest_first).alias("filled"),
    )


# --- reports ----------------------------------------------------------------------


def _utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = access_log(spark, sf_dir).where(predicates.quality(data_type=DATA_TYPE))
    return gt.site_metrics(gt.with_fractions(log), as_of=AS_OF)


@query
def utilisation_sites(spark, sf_dir):
    return gt.site_report(_utilisation(spark, sf_dir))


@query
def utilisation_clouds(spark, sf_dir):
    return gt.cloud_report(_utilisation(spark, sf_dir))


def _dashboard(spark: SparkSession, sf_dir: str, metrics=measures.REPORT_METRICS) -> DataFrame:
    return gt.site_metrics(gt.with_fractions(_usable(spark, sf_dir)), metrics)


@query
def dashboard_sites(spark, sf_dir):
    return gt.site_report(_dashboard(spark, sf_dir))


@query
def dashboard_clouds(spark, sf_dir):
    return gt.cloud_report(_dashboard(spark, sf_dir))


@query
def dashboard_wide(spark, sf_dir):
    long = gt.cloud_report(_dashboard(spark, sf_dir))
    clouds = sorted(r.r_name for r in fixtures.table(spark, sf_dir, "region").collect())
    return gt.pivot_wide(long, ["ds_scope", "metric"], "site_cloud", clouds)


@query
def joined_sites(spark, sf_dir):
    metrics = measures.JOINED_METRICS
    return gt.site_report(_dashboard(spark, sf_dir, metrics), metrics)


@query
def joined_clouds(spark, sf_dir):
    metrics = measures.JOINED_METRICS
    return gt.cloud_report(_dashboard(spark, sf_dir, metrics), metrics)


@query
def strict_pivot_check(spark, sf_dir):
    """Cells that a strict pivot of single records would have to refuse."""
    records = _usable(spark, sf_dir).select("datasetname", "ds_scope", "site_name", "number_of_jobs")
    return utilisation.repeated_cells(records, ["ds_scope", "datasetname"], "site_name")


def _not_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.quality_filter(
        access_log(spark, sf_dir), data_type=DATA_TYPE, exclude_gpu=True
    )


@query
def metric_pivot(spark, sf_dir):
    return gt.metric_pivot(_not_gpu(spark, sf_dir), "number_of_jobs", "sum")


@query
def metric_pivot_unsplit(spark, sf_dir):
    return gt.metric_pivot(_not_gpu(spark, sf_dir), "number_of_jobs", "sum", split=None)


@query
def metric_pivot_datasets(spark, sf_dir):
    return gt.metric_pivot(
        _not_gpu(spark, sf_dir), "number_of_jobs", "max", by="datasetname"
    )


@query
def metric_pivot_median(spark, sf_dir):
    return gt.metric_pivot(_not_gpu(spark, sf_dir), "jobs_timetostart", "median")


@query
def metric_pivot_wavg(spark, sf_dir):
    return _rounded(gt.metric_pivot(_not_gpu(spark, sf_dir), "jobs_timetostart", "wavg"), "value")


@query
def single_dataset_wide(spark, sf_dir):
    log = access_log(spark, sf_dir).where(predicates.quality())
    wide = gt.site_metrics(gt.with_fractions(log), by=("datasetname",))
    return _rounded(wide, "Fraction of Task Attempt Execution Time")


POPULARITY_FROM = "2001-04-02 00:00:00"  # sixty days before AS_OF


@query
def overall_popularity(spark, sf_dir):
    log = access_log(spark, sf_dir).where(predicates.quality(data_type=DATA_TYPE))
    recent = log.where(
        predicates.between("task_modificationtime", moment(POPULARITY_FROM), moment(AS_OF))
    )
    return gt.overall_popularity(recent, as_of=AS_OF)


def _in_batches(log: DataFrame) -> list[tuple[str, DataFrame]]:
    """Records around the look-backs: up to a day, after it, and late ones of both; the first comes again."""
    when, late = F.col("task_modificationtime"), F.col("jeditaskid") % 10 == 0
    near = log.where(predicates.between("task_modificationtime", moment("2001-03-20 00:00:00"), moment("2001-06-10 00:00:00")))
    cut = moment("2001-05-10 00:00:00")
    first = ("first", near.where((when < cut) & ~late))
    return [first, ("second", near.where((when >= cut) & ~late)), ("late", near.where(late)), first]


@query
def utilisation_from_states(spark, sf_dir):
    """The utilisation of sites from the daily states of three batches."""
    log = access_log(spark, sf_dir).where(predicates.quality(data_type=DATA_TYPE))
    path = workspace.fresh_path(spark, "states")
    for name, batch in _in_batches(gt.with_fractions(log)):
        utilisation.write_site_states(batch, path, name)
    return gt.site_report(utilisation.site_metrics_from_states(spark, path, as_of=AS_OF))


@query
def popularity_from_states(spark, sf_dir):
    """Overall popularity from the daily states of three batches."""
    path = workspace.fresh_path(spark, "states")
    for name, batch in _in_batches(access_log(spark, sf_dir)):
        overview.write_popularity_states(batch, path, name)
    return overview.popularity_from_states(spark, path, as_of=AS_OF)


@query
def task_execution(spark, sf_dir):
    return gt.task_execution(access_log(spark, sf_dir), start="2001-03-15", end="2001-04-15")


@query
def task_execution_of_dataset(spark, sf_dir):
    """The same of one dataset: the first by name that was read at all."""
    log = access_log(spark, sf_dir)
    first = log.agg(F.min("datasetname")).scalar()
    return gt.task_execution(log, start="1990-01-01", end="2010-01-01", dataset=first)


@query
def report_quantiles(spark, sf_dir):
    """Median, ninth decile, extremes and counts beside sums, over the look-backs."""
    hows = {"median": "avg", "q90": "avg", "min": "min", "max": "max", "count": "sum"}
    metrics = [
        measures.Metric(how, "jobs_timetostart", how, {"avg": "mean"}.get(across, across))
        for how, across in hows.items()
    ]
    log = access_log(spark, sf_dir).where(predicates.quality(data_type=DATA_TYPE))
    return _rounded(utilisation.to_long(gt.site_metrics(log, metrics, as_of=AS_OF),
                    ["lookback", "ds_scope", "site_cloud", "site_name"], list(hows)), "value", digits=6)


@query
def report_fractional(spark, sf_dir):
    """Sums and averages of a column with fractions."""
    metrics = [measures.Metric(how, "cpu_hours", how, "sum") for how in ("sum", "wavg", "mean", "max")]
    values = gt.site_metrics(_usable(spark, sf_dir), metrics)
    return _rounded(values, "sum", "wavg", "mean")


@query
def declared_read(spark, sf_dir):
    """Records written as JSON and read back by the declared schema."""
    path = workspace.fresh_path(spark, "declared")
    columns = ["jeditaskid", "datasetname", "site_name", "attempt_start", "ds_replicas_number", "number_of_jobs"]
    files.write_json(access_log(spark, sf_dir).select(*columns), path)
    read = spark.read.schema(declared_schema()).option("timestampNTZFormat", scalars.TIME_FORMAT)
    return read.json(path, mode="FAILFAST").select(*columns)


@query
def bounded_search(spark, sf_dir):
    wanted = predicates.between("task_modificationtime", moment("2001-03-15"), moment(AS_OF))
    columns = ["jeditaskid", "datasetname", "site_name", "jobstatus", "number_of_jobs"]
    return files.bounded_search(access_log(spark, sf_dir), wanted, columns, columns, 1000)


@query
def document_scan(spark, sf_dir):
    wanted = predicates.quality(data_type=DATA_TYPE) & predicates.between(
        "task_modificationtime", moment("2001-03-15"), moment(AS_OF)
    )
    columns = ["jeditaskid", "datasetname", "username", "site_name", "ds_bytes"]
    return files.scan(access_log(spark, sf_dir), wanted, columns)


@query
def log_table(spark, sf_dir):
    """The log written by month and read back for a time range."""
    path = workspace.fresh_path(spark, "log")
    columns = ["jeditaskid", "datasetname", "site_name", "task_modificationtime", "ds_bytes"]
    files.write_log(access_log(spark, sf_dir).select(*columns), path)
    return files.read_log(spark, path, "2001-03-15 00:00:00", AS_OF, columns)


@query
def clustered_lookup(spark, sf_dir):
    """The log laid out by time and dataset; two years of the first dataset read from it."""
    path = workspace.fresh_path(spark, "log")
    columns = ["jeditaskid", "datasetname", "site_name", "task_modificationtime", "number_of_jobs"]
    log = access_log(spark, sf_dir).select(*columns)
    files.write_clustered_log(log, path)
    months = "1998-01-01 00:00:00", "1999-12-31 00:00:00"
    name = spark.read.parquet(path).agg(F.min("datasetname")).scalar()
    return files.read_log(spark, path, *months, columns).where(F.col("datasetname") == name)


@query
def training_extract(spark, sf_dir):
    rows = gt.training_extract(access_log(spark, sf_dir), marker="PROMO")
    return rows.select("jeditaskid", "datasetname", "ds_data_type_desc", "site_name", "queue")


@query
def subset_extract(spark, sf_dir):
    return gt.subset_extract(
        access_log(spark, sf_dir), subtype="PROMO4", project=PROJECT, project_col="ds_scope"
    )


# --- sites ------------------------------------------------------------------------


@query
def replica_inventory(spark, sf_dir):
    held = gt.replica_inventory(_usable(spark, sf_dir))
    return held.withColumn("replicas_volume", F.col("replicas_volume").cast("double"))


@query
def processed_by_site(spark, sf_dir):
    done = gt.processed_by_site(_usable(spark, sf_dir))
    return done.withColumn("processed_data_volume", F.col("processed_data_volume").cast("double"))


@query
def inventory_and_processing(spark, sf_dir):
    columns = ["site_name", "datasetname", "ds_bytes", "ds_replicas_sites"]
    usable = _usable(spark, sf_dir).select(*columns, "jobs_primary_input_fsize")
    return gt.inventory_and_processing(usable)


@query
def inventory_top(spark, sf_dir):
    columns = ["site_name", "datasetname", "ds_bytes", "ds_replicas_sites"]
    usable = _usable(spark, sf_dir).select(*columns, "jobs_primary_input_fsize")
    return gt.inventory_and_processing(usable, 50)


@query
def storage_locality(spark, sf_dir):
    return gt.storage_locality(_usable(spark, sf_dir), fixtures.site_volume(spark, sf_dir))


@query
def is_local_flag(spark, sf_dir):
    flagged = gt.with_local_flag(_usable(spark, sf_dir))
    return flagged.groupBy("site_name", "local").agg(F.count(F.lit(1)).alias("n_records"))


ACCOUNTING_FROM, ACCOUNTING_TO = "1999-03-01 00:00:00", "2001-03-02 00:00:00"


def _accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixtures.accounting_documents(spark, sf_dir)
    return gt.site_accounting(documents, ACCOUNTING_FROM, ACCOUNTING_TO)


@query
def site_accounting(spark, sf_dir):
    return _accounting(spark, sf_dir)


@query
def site_accounting_top(spark, sf_dir):
    documents = fixtures.accounting_documents(spark, sf_dir)
    return gt.site_accounting(documents, ACCOUNTING_FROM, ACCOUNTING_TO, keys_per_level=3)


@query
def bucket_flatten(spark, sf_dir):
    answers = fixtures.nest_buckets(_accounting(spark, sf_dir))
    path = workspace.fresh_path(spark, "answers")
    answers.write.text(path)
    return gt.flatten_buckets(spark.read.text(path), "value", ACCOUNTING_FROM)


@query
def bucket_files(spark, sf_dir):
    path = workspace.fresh_path(spark, "answers")
    fixtures.nest_buckets(_accounting(spark, sf_dir)).write.text(path)
    answers = spark.read.schema(bucket_tree_ddl()).json(path)
    as_text = answers.select(F.to_json(F.struct("*")).alias("answer"))
    flat = gt.flatten_buckets(as_text, "answer", ACCOUNTING_FROM)
    return flat.groupBy("site").agg(F.sum("bytes").alias("bytes"))


# --- sources and sinks --------------------------------------------------------------

RECORD = [
    "jeditaskid",
    "datasetname",
    "site_name",
    "queue",
    "attempt_start",
    "number_of_jobs",
    "ds_replicas_sites",
]


def _at_rest(log: DataFrame) -> DataFrame:
    """Records joined once and stored, for queries that take their batches from them."""
    path = workspace.fresh_path(log.sparkSession, "records")
    log.write.parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def _ddl(columns: list[str]) -> str:
    types = dict(part.split() for part in " ".join(ACCESS_LOG_DDL.split()).split(", "))
    return ", ".join(f"{c} {types[c]}" for c in columns)


@query
def csv_union(spark, sf_dir):
    """Two CSV layouts written from the log and read back as one table by name."""
    log = access_log(spark, sf_dir)
    path = workspace.fresh_path(spark, "csv")
    narrow = ["datasetname", "ds_bytes", *[c for c in RECORD if c not in ("queue", "datasetname")]]
    files.write_csv(log.where(F.col("jobstatus") == "finished").select(*RECORD), f"{path}/wide")
    files.write_csv(log.where(F.col("jobstatus") == "failed").select(*narrow), f"{path}/narrow")
    layouts = [f"{path}/wide/*.csv", f"{path}/narrow/*.csv"]
    return files.read_csv_layouts(spark, layouts, _ddl(RECORD))


@query
def csv_scan(spark, sf_dir):
    path = workspace.fresh_path(spark, "csv")
    files.write_csv(access_log(spark, sf_dir).select(*RECORD), path)
    return files.read_csv(spark, path, _ddl(RECORD))


@query
def csv_bad_lines(spark, sf_dir):
    """Records beside lines that are no records; only the former come back."""
    log = access_log(spark, sf_dir)
    path = workspace.fresh_path(spark, "csv")
    columns = ["jeditaskid", "datasetname", "number_of_jobs"]
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    surplus = F.concat_ws(",", line, F.lit("one field"), F.lit("too many"))
    empty = F.concat(line, F.lit(","))
    lines = (
        F.when(F.col("jobstatus") == "failed", surplus)
        .when(F.col("jeditaskid") % 7 == 0, empty)
        .otherwise(line)
    )
    log.select(lines.alias("value")).write.text(path)
    return files.read_csv(spark, path, _ddl(columns), header=False, drop_bad_lines=True)


def _mixed_lines(log: DataFrame) -> DataFrame:
    """Records as lines; some have a field too many, a name for a number, or a field too few."""
    columns = ["jeditaskid", "datasetname", "number_of_jobs"]
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    line = F.concat_ws(",", *fields)
    kind = F.col("jeditaskid") % 6
    return log.select(
        F.when(kind == 0, F.concat(line, F.lit(",more")))
        .when(kind == 1, F.concat_ws(",", *fields[:2], F.col("site_name")))
        .when(kind == 2, F.concat_ws(",", *fields[:2]))
        .otherwise(line)
        .alias("value")
    )


JUDGED = "jeditaskid bigint, datasetname string, number_of_jobs bigint"


@query
def csv_rejects(spark, sf_dir):
    """Rows and rejects of the same lines: each line is one of them."""
    path = workspace.fresh_path(spark, "csv")
    _mixed_lines(access_log(spark, sf_dir)).write.text(path)
    judged = files.read_csv_judged(spark.read, path, JUDGED, header=False)
    rows = files.accepted(judged).withColumns({"text": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")})
    return rows.unionByName(files.rejected(judged).drop("file"), allowMissingColumns=True)


@query
def hourly_rejects(spark, sf_dir):
    """The same taken in as a stream, which no line stops: rows and rejects as stored."""
    path = workspace.fresh_path(spark, "hourly")
    log = access_log(spark, sf_dir)
    for part in (F.col("jobstatus") == "failed", F.col("jobstatus") != "failed"):
        _mixed_lines(log.where(part)).write.mode("append").text(f"{path}/in")
    judged = files.read_csv_judged(spark.readStream, f"{path}/in", JUDGED, header=False)
    hourly.start(judged, f"{path}/log", f"{path}/checkpoint", rejects_path=f"{path}/rejects").awaitTermination()
    rows = spark.read.parquet(f"{path}/log").select("jeditaskid", "datasetname", "number_of_jobs")
    rejects = spark.read.parquet(f"{path}/rejects").select("text", "reason")
    return rows.unionByName(rejects, allowMissingColumns=True)


@query
def upsert_by_task(spark, sf_dir):
    log = access_log(spark, sf_dir).select(*RECORD, "task_modificationtime")
    target = log.where(F.col("task_modificationtime") < moment(CUT))
    batch = log.where(F.col("task_modificationtime") >= moment(CUT))
    return gt.replace_by_task(target, gt.clean_batch(batch)).select(*RECORD)


@query
def nested_text(spark, sf_dir):
    """Replica information as quoted text, some of it broken, parsed row by row."""
    log = access_log(spark, sf_dir)
    n, site = F.col("number_of_jobs").cast("string"), F.col("site_name")
    forms = [
        F.concat(F.lit("[{'site':'"), site, F.lit("','n':"), n, F.lit(", 'disk': True}]")),
        F.concat(F.lit("({'site': 'the \\\"big\\\" (None) "), site, F.lit("', 'n': None, 'disk': False,},)")),
        F.concat(F.lit("[{'site': \"O'"), site, F.lit('", "n": '), n, F.lit("},]")),
    ]
    text = F.lit("[{'site'")
    for k, form in enumerate(forms):
        text = F.when((F.col("jobstatus") != "failed") & (F.col("jeditaskid") % 3 == k), form).otherwise(text)
    batch = log.select("jeditaskid", text.alias("ds_replicas_info"))
    parsed = gt.clean_batch(batch, "array<struct<site:string,n:bigint,disk:boolean>>")
    info = F.try_element_at("ds_replicas_info", F.lit(1))
    fields = [info[c].alias(c) for c in ("site", "n", "disk")]
    return parsed.select("jeditaskid", *fields, F.col("ds_replicas_info_unread").alias("unread"))


@query
def nested_misfits(spark, sf_dir):
    """Records with fields that do not fit: alone, and in a list after one that fits."""
    log = access_log(spark, sf_dir)
    task, n, site = F.col("jeditaskid"), F.col("number_of_jobs").cast("string"), F.col("site_name")
    forms = [
        F.concat(F.lit("{'a': "), n, F.lit(", 'b': '"), site),
        F.concat(F.lit("{'a': '"), site, F.lit("'}")),
        F.concat(F.lit("{'a': "), n, F.lit(".5, 'b': '"), site, F.lit("'}")),
        F.concat(F.lit("{'a': "), n, F.lit(", 'c': '"), site, F.lit("'}")),
    ]
    text = F.concat(F.lit("{'a': "), n, F.lit(", 'b': '"), site, F.lit("',}"))
    for k, form in enumerate(forms):
        text = F.when(task % 5 == k, form).otherwise(text)
    pair = "struct<a:bigint,b:string>"
    batch = log.select("jeditaskid", text.alias("one"), F.concat(F.lit("[{'a': 7},"), text, F.lit(",]")).alias("many"))
    for column, kind in (("one", pair), ("many", f"array<{pair}>")):
        batch = upsert.clean_batch(batch, kind, column)
    second = F.try_element_at("many", F.lit(2))
    return batch.select(
        "jeditaskid",
        F.col("one.a").alias("a"),
        F.col("one.b").alias("b"),
        F.col("one_unread").alias("unread"),
        second["a"].alias("list_a"),
        second["b"].alias("list_b"),
        F.col("many_unread").alias("list_unread"),
    )


@query
def doc_id_dedup(spark, sf_dir):
    order = [F.desc("number_of_jobs"), F.desc("site_name")]
    columns = [*upsert.DOCUMENT_KEY, "number_of_jobs", "site_name"]
    records = access_log(spark, sf_dir).select(*columns)
    kept = gt.keyed_documents(records, order)
    return kept.select("jeditaskid", "datasetname", "queue", "number_of_jobs", "site_name")


@query
def document_ids(spark, sf_dir):
    key = ["jeditaskid", "datasetname", "jobstatus"]
    return access_log(spark, sf_dir).select(*key, upsert.document_id(key).alias("doc_id"))


@query
def json_records(spark, sf_dir):
    records = access_log(spark, sf_dir).select("jeditaskid", "datasetname", "queue")
    return files.to_json_records(records)


@query
def report_sheets(spark, sf_dir):
    """The dashboard written as one folder per cloud and metric, and read back."""
    long = gt.site_report(_dashboard(spark, sf_dir)).withColumn("report", F.lit("dashboard"))
    path = workspace.fresh_path(spark, "report")
    sinks.write_report(long, path, ("report", "site_cloud", "metric"))
    return spark.read.parquet(path)


@query
def advice_fan_out(spark, sf_dir):
    """Advice of every pair written as one folder per project and data type."""
    path = workspace.fresh_path(spark, "advice")
    sinks.write_fan_out(_by_project(spark, sf_dir), path)
    return spark.read.parquet(path)


@query
def hourly_batches(spark, sf_dir):
    """Two CSV batches taken in as a stream; the later one replaces its tasks."""
    log = _at_rest(access_log(spark, sf_dir).select(*RECORD, "task_modificationtime"))
    earlier = F.col("task_modificationtime") < moment(CUT)
    path = workspace.fresh_path(spark, "hourly")
    for part in (log.where(earlier), log.where(~earlier)):
        files.write_csv(part.select(*RECORD), f"{path}/in", mode="append")
        stream = hourly.read_hourly(spark, f"{path}/in", _ddl(RECORD))
        hourly.start(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return hourly.current_records(spark.read.parquet(f"{path}/log"))


@query
def replace_stored(spark, sf_dir):
    """A batch written over a log stored by month, which is then read whole."""
    log = _at_rest(access_log(spark, sf_dir).select(*RECORD, "task_modificationtime"))
    earlier = F.col("task_modificationtime") < moment(CUT)
    path = workspace.fresh_path(spark, "log")
    files.write_log(log.where(earlier), path)
    files.replace_in_log(spark, path, log.where(~earlier))
    return spark.read.parquet(path).select(*RECORD)


@query
def replace_stored_fewer(spark, sf_dir):
    """A batch without one of the log's columns: the other tasks keep theirs."""
    log = _at_rest(access_log(spark, sf_dir).select(*RECORD, "task_modificationtime"))
    earlier = F.col("task_modificationtime") < moment(CUT)
    path = workspace.fresh_path(spark, "log")
    files.write_log(log.where(earlier), path)
    files.replace_in_log(spark, path, log.where(~earlier).drop("number_of_jobs"))
    return spark.read.parquet(path).select(*RECORD)


@query
def keyed_twice(spark, sf_dir):
    """Loads into a table of one row per id: older rows, newer ones, the older again, all twice."""
    columns = [*upsert.DOCUMENT_KEY, "number_of_jobs", "site_name"]
    newer = _at_rest(access_log(spark, sf_dir).select(*columns))
    older = newer.where(F.col("jeditaskid") % 3 == 0).withColumn("number_of_jobs", F.col("number_of_jobs") - 1)
    order = [F.desc("number_of_jobs"), F.desc("site_name")]
    path = workspace.fresh_path(spark, "keyed")
    for batch in (older, newer.where(F.col("jeditaskid") % 2 == 0), older, newer, newer):
        keyed.merge_documents(spark, path, batch, order, buckets=8)
    return keyed.read_stored(spark, path, buckets=8).select(
        "jeditaskid", "datasetname", "queue", "number_of_jobs", "site_name"
    )


@query
def stream_late(spark, sf_dir):
    """Four extracts as a stream: newer before older, one in two files, one file twice."""
    log = _at_rest(access_log(spark, sf_dir).select(*RECORD))
    turn = F.col("jeditaskid") % 4
    hours = [F.lit(f"2001-06-01 0{n}:00:00").cast("timestamp_ntz") for n in range(4)]

    def extract(n: int, tasks) -> DataFrame:
        jobs = F.col("number_of_jobs") + 100 * n
        return log.where(tasks).withColumns({"number_of_jobs": jobs, "extracted": hours[n]})

    whole, first, second, third = (
        extract(n, tasks) for n, tasks in enumerate((F.lit(True), turn >= 1, turn >= 2, turn >= 3))
    )
    half = F.col("number_of_jobs") % 2 == 0
    path = workspace.fresh_path(spark, "extracts")
    for arrivals in ((second, whole), (first.where(half), third, first.where(~half)), (whole, second)):
        for part in arrivals:
            files.write_csv(part, f"{path}/in", mode="append", compression="gzip")
        stream = hourly.read_hourly(spark, f"{path}/in", third.schema)
        extracts_stream.start(stream, f"{path}/table", f"{path}/checkpoint", "extracted", buckets=8).awaitTermination()
    return keyed.read_stored(spark, f"{path}/table", buckets=8).select(*RECORD)


@query
def hourly_compacted(spark, sf_dir):
    """Batches of three spans, the last two replacing tasks, compacted before they are read."""
    log = _at_rest(access_log(spark, sf_dir).select(*RECORD, "task_modificationtime"))
    when = F.col("task_modificationtime")
    first, cut = moment("1999-01-01 00:00:00"), moment(CUT)
    path = workspace.fresh_path(spark, "hourly")
    store = hourly.append_batch(path)
    for number, part in enumerate((when < first, (when >= first) & (when < cut), when >= cut)):
        store(log.where(part).select(*RECORD), number)
    hourly.compact(spark, path)
    return hourly.current_records(spark.read.parquet(path))


# --- single expressions ---------------------------------------------------------------


@query
def queue_time(spark, sf_dir):
    minutes = scalars.queue_time("task_creationdate", "attempt_start").alias("queue_time")
    return access_log(spark, sf_dir).select("jeditaskid", "datasetname", minutes)


@query
def text_times(spark, sf_dir):
    """Times written as text and read again."""
    written = F.col("attempt_start").cast("string").alias("text")
    log = access_log(spark, sf_dir).select("jeditaskid", written)
    return log.select("jeditaskid", scalars.parse_time("text").alias("attempt_start"))


@query
def time_slice(spark, sf_dir):
    inside = predicates.half_open("attempt_start", moment(CUT), moment(AS_OF))
    return access_log(spark, sf_dir).where(inside).select("jeditaskid", "attempt_start")


@query
def strip_digits(spark, sf_dir):
    return (
        access_log(spark, sf_dir)
        .groupBy(scalars.strip_digits("ds_data_type_desc").alias("ds_data_type_desc"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


@query
def unit_conversion(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return log.select(
        "jeditaskid",
        scalars.div("jobs_total_duration", scalars.MINUTE).alias("minutes"),
        scalars.div("jobs_total_inputfilebytes", scalars.TIB).alias("input_tib"),
        scalars.div("jobs_total_inputfilebytes", scalars.TB).alias("input_tb"),
        scalars.div("jobs_total_outputfilebytes", scalars.GB).alias("output_gb"),
        scalars.fraction("jobs_primary_input_fsize", "ds_bytes").alias("fraction_of_dataset"),
        scalars.fraction("jobs_total_duration", "attempt_total_duration", 60).alias("fraction_60"),
    )


@query
def weighted_average(spark, sf_dir):
    return (
        access_log(spark, sf_dir)
        .where(predicates.not_null("site_cloud", "ds_scope"))
        .groupBy("site_cloud", "ds_scope")
        .agg(measures.weighted_average("jobs_timetostart").alias("wavg_wait"))
    )


@query
def median_p90(spark, sf_dir):
    log = access_log(spark, sf_dir).where(predicates.not_null("site_cloud", "ds_scope"))
    quantiles = measures.quantiles(
        log, ["site_cloud", "ds_scope"], "jobs_timetostart", {"median": 0.5, "q90": 0.9}
    )
    return _rounded(quantiles, "q90", digits=6)


@query
def round_to_base(spark, sf_dir):
    rounded = scalars.round_to_base("number_of_jobs", 5).alias("rounded")
    tens = scalars.round_to_base(scalars.div("jobs_timetostart", 60), 10).alias("wait_tens")
    return access_log(spark, sf_dir).groupBy(rounded, tens).agg(
        F.count(F.lit(1)).alias("n_records")
    )


@query
def rename_and_constants(spark, sf_dir):
    names = {"number_of_jobs": "n_jobs", "username": "user"}
    return (
        extracts.prepared_extract(
            access_log(spark, sf_dir), ["jeditaskid", *names], data_type=DATA_TYPE
        )
        .withColumnsRenamed(names)
        .withColumn("report_date", F.lit(AS_OF[:10]))
    )
