"""Jobs on literal frames: the edge cases of each rule."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import gridtally as gt
from gridtally.operators import frequency, rolling, utilisation
from gridtally.plans import fixtures
from gridtally.schema import ACCESS_LOG_DDL, WEEKLY_ADVICE_DDL

DAY = dt.datetime(2021, 2, 1)
LOG = (
    "datasetname string, jeditaskid bigint, username string, attempt_start timestamp_ntz, "
    "ds_replicas_number tinyint, site_name string, site_cloud string, ds_bytes bigint"
)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def log(spark, rows):
    full = [
        (r[0], r[1], r[2], None if r[3] is None else at(r[3]), *r[4:], *([None] * (8 - len(r))))
        for r in rows
    ]
    return spark.createDataFrame(full, LOG)


def by(df, key="datasetname"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_advice_by_hand(spark):
    rows = [
        ("a", 1, "u", 0, 2),
        ("a", 1, "u", 0.5, 2),  # the same task again in the interval counts once
        ("a", 2, "u", 75, 3),
        ("b", 3, "u", 10, 1),
        ("b", 4, "v", 80, None),  # the last record: latest, but in no interval
        ("c", 5, "v", None, 7),  # no time: listed with zeros
        (None, 6, "v", 20, 1),  # no name: dropped
    ]
    got = by(gt.replication_advice(log(spark, rows), n=8))
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["datasetAF"] == (2**-7 + 1) / 8
    assert got["b"]["datasetAF"] == 2**-6 / 8
    group = (2**-7 + 1 + 2**-6) / (8 * 3)
    assert got["c"]["groupAF"] == pytest.approx(group)
    assert got["a"]["optimal_n_replicas"] == round(got["a"]["datasetAF"] / group)
    assert (got["a"]["curr_n_replicas"], got["b"]["curr_n_replicas"]) == (3, None)
    assert (got["a"]["curr_n_accesses"], got["b"]["curr_n_accesses"]) == (1, 0)
    assert got["a"]["decision"] == got["a"]["optimal_n_replicas"] - 3
    assert got["b"]["decision"] is None


def test_advice_on_a_single_time(spark):
    got = by(gt.replication_advice(log(spark, [("a", 1, "u", 4, 2), ("b", 2, "u", 4, 1)])))
    assert got["a"]["datasetAF"] == 0
    assert got["a"]["groupAF"] == 0
    assert got["a"]["optimal_n_replicas"] is None


def test_empty_tables_give_empty_results(spark):
    df = log(spark, [])
    moved = df.withColumnRenamed("attempt_start", "task_modificationtime")
    advice = gt.replication_advice(df)
    for result in (
        advice,
        gt.interval_access(df),
        gt.place_shares(df, "site"),
        gt.placement(df, advice, "cloud"),
        gt.rolling_advice(moved),
        gt.advice_outcome(gt.rolling_advice(moved), gt.rolling_calendar(moved)),
    ):
        assert result.collect() == []


def brute_force_profile(rows, n):
    times = [r[3] for r in rows if r[3] is not None]
    lo, span = min(times), int((max(times) - min(times)) * 3600)
    starts = [k * span // n for k in range(n)] + [span]
    seen = defaultdict(set)
    for r in rows:
        o = int((r[3] - lo) * 3600)
        for k in range(n):
            if starts[k] <= o < starts[k + 1]:
                seen[r[0], k].add(r[1])
    return {d: [len(seen[d, k]) for k in range(n)] for d in {r[0] for r in rows}}


def test_interval_access_against_loops(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice("abcd"), rng.randint(1, 30), "u", rng.randint(0, 500), 1) for _ in range(300)
    ]
    got = defaultdict(list)
    for r in gt.interval_access(log(spark, rows), n=10).orderBy("timestamp").collect():
        got[r.datasetname].append(r.n_accesses)
    assert dict(got) == brute_force_profile(rows, 10)


def test_shares_sum_to_one_and_cover_every_place(spark):
    rng = random.Random(6)
    rows = [
        (
            rng.choice("abc"),
            rng.randint(1, 40),
            "u",
            rng.randint(0, 300),
            rng.randint(1, 4),
            rng.choice(["S1", "S2", "S3"]),
            rng.choice(["C1", "C2", None]),
        )
        for _ in range(200)
    ] + [("idle", 99, "u", 300, 1, "S4", "C3")]  # only at the very end: in no interval
    df = log(spark, rows)
    for place, places in (("cloud", ["C1", "C2", "C3"]), ("site", ["S1", "S2", "S3", "S4"])):
        used = gt.place_shares(df, place).collect()
        assert all(r.weighted_accesses > 0 for r in used)
        assert {r.datasetname for r in used} == {"a", "b", "c"}
        dense = gt.place_shares(df, place, places=places)
        assert {tuple(r) for r in used} <= {tuple(r) for r in dense.collect()}
        per = dense.groupBy("datasetname").agg(
            F.count(F.lit(1)).alias("n"), F.sum(f"x_{place}s").alias("total")
        )
        got = by(per)
        assert all(r["n"] == len(places) for r in got.values())
        assert got["a"]["total"] == pytest.approx(1)
    # a task may use several sites, so site use is never below the dataset's own
    site = gt.place_shares(df, "site").groupBy("datasetname").agg(
        F.sum("weighted_accesses").alias("w"), F.max("ds_avg_access_frequency").alias("af")
    )
    assert all(r["w"] >= r["af"] - 1e-12 for r in by(site).values())


def test_placement_leaves_out_idle_datasets(spark):
    rows = [
        ("a", 1, "u", 0, 1, "S1", None),
        ("b", 2, "u", 5, 1, "S1", "C1"),
        ("idle", 3, "u", 80, 1, "S2", "C2"),
    ]
    df = log(spark, rows)
    prior = gt.replication_advice(df)
    used = gt.placement(df, prior, "cloud").collect()
    assert [(r.datasetname, r.cloud) for r in used] == [("b", "C1")]
    rows = gt.placement(df, prior, "cloud", places=["C1", "C2"]).collect()
    got = {(r.datasetname, r.cloud): r for r in rows}
    assert set(got) == {(d, c) for d in "ab" for c in ("C1", "C2")}
    assert got["a", "C1"].replicas_at_cloud is None  # used, but at no known cloud
    assert got["b", "C1"].datasetAF_cloud > 0
    assert got["b", "C2"].datasetAF_cloud == 0


def test_mean_at_latest(spark):
    rows = [("a", 1, "u", 0, 9), ("a", 2, "u", 5, 2), ("a", 3, "u", 5, 5), ("b", 1, "u", 5, None)]
    got = by(gt.dataset_frequency(log(spark, rows)))
    assert got["a"]["current_n_replicas"] == 3.5
    assert got["b"]["current_n_replicas"] is None


def test_frequency_for_list_counts_the_whole_list(spark):
    df = log(spark, [("a", 1, "u", 0, 1), ("a", 2, "u", 7, 1), ("z", 3, "u", 8, 1)])
    listed = spark.createDataFrame([("a",), ("gone",)], "datasetname string")
    got = by(gt.frequency_for_list(df, listed))
    assert set(got) == {"a", "gone"}
    assert got["gone"]["new_datasetAF"] == 0
    assert got["a"]["new_groupAF"] == got["a"]["new_datasetAF"] / 2


def test_most_popular_and_filter(spark):
    df = log(spark, [("a", 1, "u", 0), ("a", 2, "v", 0), ("b", 1, "u", 0), ("c", 3, "u", 0)])
    top = gt.most_popular(df, "datasetname", 2)
    assert [(r.datasetname, r.n_tasks) for r in top.collect()] == [("a", 2), ("b", 1)]
    assert gt.keep_popular(df, "datasetname", top).count() == 3
    assert gt.multi_user(df).count() == 2


# --- rolling ----------------------------------------------------------------------


def loops_over_windows(rows, length=60 * 86400, step=7 * 86400, n=8):
    """The window loop spelled out: datasets with a record in the window."""
    from math import exp

    timed = [(r[0], r[1], r[2], int(r[3] * 3600), r[4]) for r in rows if r[3] is not None]
    start, end = min(r[3] for r in timed), max(r[3] for r in timed)
    names = sorted({r[0] for r in rows if r[0] is not None})
    out, cur = {}, start
    while cur < end:
        part = [r for r in timed if cur <= r[3] < cur + length]
        if part:
            lo, hi = min(r[3] for r in part), max(r[3] for r in part)
            cuts = [lo + k * (hi - lo) // n for k in range(n)] + [hi]
            af, last, users = defaultdict(float), defaultdict(int), defaultdict(int)
            for k in range(n):
                inside = [r for r in part if cuts[k] <= r[3] < cuts[k + 1]]
                for d in names:
                    tasks = {r[1] for r in inside if r[0] == d}
                    who = {r[2] for r in inside if r[0] == d and r[2] is not None}
                    af[d] += len(tasks) * 2.0 ** -(n - 1 - k) / (1 + exp(5 - len(who)))
                    if k == n - 1:
                        last[d], users[d] = len(tasks), len(who)
            group = sum(af.values()) / (n * len(names))
            for d in names:
                mine = [r for r in part if r[0] == d]
                if not mine:
                    continue
                newest = max((r[3] for r in mine), default=None)
                seen = [r[4] for r in mine if r[3] == newest and r[4] is not None]
                best = round(round(af[d] / n / group, 9)) if group else None
                if best is not None:
                    best = min(best, last[d]) or 1
                out[cur - start, d] = (
                    round(af[d] / n, 9), max(seen, default=None), last[d], users[d], best
                )
        cur += step
    return out


@pytest.mark.parametrize("seed, spread", [(1, 4000), (2, 900), (3, 20000)])
def test_rolling_advice_against_the_loop(spark, seed, spread):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["a", "b", "c", "d"]),
            rng.randint(1, 25),
            rng.choice(["u", "v", "w", "x", None]),
            rng.randint(0, spread),
            rng.choice([None, 1, 2, 3]),
        )
        for _ in range(60)
    ] + [("never", 1, "u", None, 4), (None, 2, "u", -30, 1), (None, 3, "u", spread + 50, 1)]
    df = log(spark, rows).withColumnRenamed("attempt_start", "task_modificationtime")
    first = df.agg(F.min("task_modificationtime").alias("t")).first().t
    got = {
        (int((r.window_start - first).total_seconds()), r.datasetname): (
            round(r.datasetAF, 9),
            r.curr_n_replicas,
            r.curr_n_accesses,
            r.curr_n_users,
            r.optimal_n_replicas,
        )
        for r in gt.rolling_advice(df).collect()
    }
    assert got == loops_over_windows(rows)


def weekly(spark, rows):
    data = [
        (d, 0.5, 1.0, r, 1, 2, s, 10.0, at(24 * 7 * w), at(24 * 7 * w)) for d, w, s, r in rows
    ]
    return spark.createDataFrame(data, WEEKLY_ADVICE_DDL + ", window_start timestamp_ntz")


def calendar(spark, group):
    rows = [(at(24 * 7 * w), at(24 * 7 * w), g) for w, g in enumerate(group)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, window_start timestamp_ntz, groupAF double")


def outcome_by_hand(windows):
    """windows: newest last, (suggested, real)."""
    real, later = [], None
    for _, r in reversed(windows):
        later = r if r is not None else later
        real.append(later)
    s = [x for x, _ in reversed(windows)]
    if real[0] is None or s[0] is None or (len(s) >= 3 and None in s):
        return None
    created = s[0] - real[0] + sum(s[i + 1] - s[i] for i in range(1, len(s) - 1))
    least = min(x for x in real if x is not None)
    return least if created <= 0 or created < least else created


def test_outcome_against_the_difference_sum(spark):
    rng = random.Random(11)
    cases = {
        f"d{j}": [
            (
                rng.choice([None, *map(float, range(1, 9))]) if j % 3 == 0 else float(rng.randint(1, 9)),
                rng.choice([None, 1, 2, 3]),
            )
            for _ in range(1 + j % 6)
        ]
        for j in range(60)
    }
    rows = [(d, w, s, r) for d, ws in cases.items() for w, (s, r) in enumerate(ws)]
    # A dataset that has no row for a window had no use there: one replica is advised.
    for n in (6, 8):
        got = by(gt.advice_outcome(weekly(spark, rows), calendar(spark, [1.0] * n)))
        assert {d: got[d]["replicas_created_simul"] for d in cases} == {
            d: outcome_by_hand(ws + [(1.0, None)] * (n - len(ws))) for d, ws in cases.items()
        }
    holes = [r for r in rows if (r[1] + int(r[0][1:])) % 3]
    kept = {d: [c if (w + int(d[1:])) % 3 else (1.0, None) for w, c in enumerate(ws)] for d, ws in cases.items()}
    got = by(gt.advice_outcome(weekly(spark, holes), calendar(spark, [1.0] * 6)))
    assert all(
        r["replicas_created_simul"] == outcome_by_hand(kept[d] + [(1.0, None)] * (6 - len(kept[d])))
        for d, r in got.items()
    )
    got = by(gt.advice_outcome(weekly(spark, rows), calendar(spark, [1.0] * 5 + [0.0])))
    assert all(got[d]["replicas_created_simul"] is None for d, ws in cases.items() if len(ws) < 6)


def test_outcome_columns(spark):
    rows = weekly(spark, [("a", 0, 2.0, 1), ("a", 1, 6.0, 3)])
    got = by(gt.advice_outcome(rows, calendar(spark, [1.0, 1.0])))["a"]
    assert got["total_n_accesses"] == 2
    assert got["total_n_users"] == 2
    assert got["replicas_created_real"] == 3
    assert got["simul_created_volume"] == 30.0
    assert got["datasetAF"] == 0.5


def test_backfill(spark):
    from pyspark.sql import Window

    df = weekly(spark, [("a", 0, 1.0, None), ("a", 1, 1.0, 4), ("a", 2, 1.0, None), ("b", 0, 1.0, 9)])
    w = Window.partitionBy("datasetname").orderBy(F.desc("timestamp"), F.desc("window_start"))
    rows = df.select("datasetname", "timestamp", rolling.backfill("curr_n_replicas", w).alias("r"))
    got = [r.r for r in rows.orderBy("datasetname", "timestamp").collect()]
    assert got == [4, 4, None, 9]  # the end of one dataset does not borrow from the next


# --- reports ----------------------------------------------------------------------


def records(spark, rows):
    """Access-log rows from dictionaries; the rest is a plain good record."""
    base = {
        "jeditaskid": 1, "datasetname": "d", "ds_scope": "mc16_13TeV", "ds_data_type": "DAOD",
        "ds_data_type_desc": "T1", "ds_prod_step": "deriv", "ds_bytes": 100,
        "username": "u", "site_name": "S1", "site_cloud": "C1", "task_attemptnr": 0,
        "jobstatus": "finished", "attempt_status": "done", "number_of_jobs": 1,
        "jobs_total_duration": 60, "attempt_total_duration": 120,
        "jobs_primary_input_fsize": 50, "task_modificationtime": at(0),
        "jobs_total_inputfilebytes": 2**40, "jobs_total_outputfilebytes": 0,
    }
    names = [f.split()[0] for f in " ".join(ACCESS_LOG_DDL.split()).split(", ")]
    data = [tuple({**base, **r}.get(c) for c in names) for r in rows]
    return spark.createDataFrame(data, ACCESS_LOG_DDL)


def test_site_and_cloud_values(spark):
    df = records(
        spark,
        [
            {"jobs_timetostart": 60, "number_of_jobs": 1},
            {"jobs_timetostart": 300, "number_of_jobs": 3, "username": "v"},
            {"jobs_timetostart": 999999, "jeditaskid": None, "number_of_jobs": 1},
            {"jobs_timetostart": None, "number_of_jobs": 5},
            {"jobs_timetostart": 120, "site_name": "S2", "number_of_jobs": 2},
            {"site_cloud": None, "number_of_jobs": 100},
        ],
    )
    values = gt.site_metrics(gt.with_fractions(df))
    sites = {(r.site_name, r.metric): r.value for r in gt.site_report(values).collect()}
    clouds = {r.metric: r.value for r in gt.cloud_report(values).collect()}
    wait = "Jobs Waiting Time (minutes) per Task"
    assert sites["S1", wait] == 4.0  # without the row that has no task
    assert sites["S1", "Total Number of Jobs"] == 10.0
    assert sites["S1", "Individual Analysis Users"] == 2.0
    assert clouds[wait] == 3.0  # plain mean of the two sites
    assert clouds["Individual Analysis Users"] == 2.0
    assert clouds["Total Number of Jobs"] == 12.0
    assert sites["S1", "Fraction of Task Attempt Execution Time"] == 0.5
    assert sites["S1", "Max Input Volume per Task (TB)"] == 1.0


def test_missing_values_have_no_row(spark):
    values = gt.site_metrics(gt.with_fractions(records(spark, [{"jobs_timetostart": None}])))
    metrics = {r.metric for r in gt.site_report(values).collect()}
    assert "Jobs Waiting Time (minutes) per Task" not in metrics
    assert "Total Number of Jobs" in metrics


def test_lookbacks_nest(spark):
    as_of = "2021-06-30 00:00:00"
    end = dt.datetime(2021, 6, 30)
    df = records(
        spark,
        [
            {"task_modificationtime": end - dt.timedelta(days=d), "username": f"u{d}"}
            for d in (0, 7, 8, 30, 59, 60, 61)
        ],
    )
    values = gt.site_metrics(gt.with_fractions(df), as_of=as_of)
    got = {r.lookback: r["Individual Analysis Users"] for r in values.collect()}
    assert got == {"last_week": 2, "last_month": 4, "last_2_months": 6}
    overall = gt.overall_popularity(df.withColumn("task_creationdate", F.lit(at(1)))
                                    .withColumn("attempt_start", F.lit(at(0))), as_of=as_of)
    rows = {r.lookback: r for r in overall.collect()}
    assert {k: r.n_users for k, r in rows.items()} == {
        "Last Week": 2, "Last Month": 4, "Last 2 Months": 6
    }
    assert rows["Last Week"]["queue_time(min)"] == 60.0
    assert rows["Last Week"]["replication_factor"] == 0  # missing values become 0
    assert (rows["Last Month"].TimestampStart, rows["Last Month"].TimestampEnd) == (
        "2021-05-31", "2021-06-30"
    )


def test_metric_pivot_limit_and_quantiles(spark):
    df = records(
        spark,
        [
            {"ds_scope": s, "number_of_jobs": j, "site_name": n, "site_cloud": c}
            for s, j, n, c in [("p1", 1, "S1", "C1"), ("p1", 4, "S1", "C1"), ("p2", 2, "S2", "C2"),
                               ("p3", 3, "S2", "C2")]
        ],
    )
    got = gt.metric_pivot(df, "number_of_jobs", "median", limit=1).collect()
    assert {(r.part, r.ds_scope, r.site_name, r.value) for r in got} == {
        ("within_cloud", "p1", "S1", 2.5),
        ("within_cloud", "p2", "S2", 2.0),
        ("all_sites", "p1", "S1", 2.5),
        ("by_cloud", "p1", None, 2.5),
    }


def test_metric_pivot_without_split(spark):
    df = records(spark, [{"site_cloud": None, "number_of_jobs": 2}, {"number_of_jobs": 2**62}] * 2)
    got = gt.metric_pivot(df, "number_of_jobs", "sum", split=None).collect()
    assert [(r.ds_scope, r.site_name, r.value) for r in got] == [
        ("mc16_13TeV", "S1", float(2**63 + 4))
    ]


def test_pivot_wide_and_repeated_cells(spark):
    long = spark.createDataFrame(
        [("p", "C1", 1.0), ("p", "C2", 2.0), ("q", "C1", 3.0)], "p string, c string, value double"
    )
    wide = {r.p: (r.C1, r.C2) for r in gt.pivot_wide(long, ["p"], "c", ["C1", "C2"]).collect()}
    assert wide == {"p": (1.0, 2.0), "q": (3.0, None)}
    assert utilisation.repeated_cells(long, ["p"], "c").count() == 0
    assert utilisation.repeated_cells(long.union(long.limit(1)), ["p"], "c").count() == 1
    with pytest.raises(Exception, match="not among the listed columns"):
        gt.pivot_wide(long, ["p"], "c", ["C1"]).collect()
    with pytest.raises(Exception, match="more than one value"):
        gt.pivot_wide(long.union(long.limit(1)), ["p"], "c", ["C1", "C2"]).collect()
    assert gt.pivot_wide(long, ["p"], "c").columns == ["p", "C1", "C2"]


# --- sites ------------------------------------------------------------------------


def test_replica_inventory_counts_snapshots(spark):
    df = records(
        spark,
        [
            {"ds_replicas_sites": "A,B", "ds_bytes": 10},
            {"ds_replicas_sites": "A,B", "ds_bytes": 10},
            {"ds_replicas_sites": "A", "ds_bytes": 10},
            {"ds_replicas_sites": None, "ds_bytes": 10},
            {"ds_replicas_sites": "A", "ds_bytes": 7, "datasetname": "e"},
        ],
    )
    got = by(gt.replica_inventory(df), "ds_replicas_sites")
    assert (got["A"]["n_replicas"], int(got["A"]["replicas_volume"])) == (2, 27)
    assert (got["B"]["n_replicas"], int(got["B"]["replicas_volume"])) == (1, 10)


def test_storage_locality(spark):
    tb = 10**12
    df = records(
        spark,
        [
            {"is_local": 1, "ds_bytes": tb, "ds_replicas_sites": "S1"},
            {"is_local": 1, "ds_bytes": tb, "ds_replicas_sites": "S1,S2"},  # the same dataset
            {"is_local": 2, "ds_bytes": tb, "ds_replicas_sites": "S2"},
            {"is_local": 2, "ds_bytes": tb, "site_name": "S2", "ds_replicas_sites": "S1"},
        ],
    )
    volumes = spark.createDataFrame(
        [("S1", 4 * tb), ("S2", 2 * tb), ("S3", tb)], "site_name string, total_volume bigint"
    )
    got = by(gt.storage_locality(df, volumes), "site_name")
    assert (got["S1"]["local_accessed"], got["S1"]["local%"]) == (1.0, 25.0)
    assert got["S1"]["total_accessed"] is None  # nothing came from tape
    assert (got["S2"]["remote%"], got["S2"]["local%"]) == (50.0, None)  # kept without local use
    assert got["S3"]["site_cloud"] is None


def test_flatten_undoes_nest(spark):
    rng = random.Random(2)
    rows = sorted(
        {tuple(rng.choice("xyz") + str(level) for level in range(5)) for _ in range(80)}
    )
    flat = spark.createDataFrame(
        [(*r, float(i)) for i, r in enumerate(rows)],
        "site string, datatype string, datatypeg string, prodstep string, scope string, bytes double",
    )
    names = flat.columns
    for levels in (1, 2, 4):
        answers = fixtures.nest_buckets(flat, levels)
        assert answers.count() == flat.select(*names[:levels]).distinct().count()
        back = gt.flatten_buckets(answers, "answer", "2021-03-01 00:00:00")
        got = sorted(map(tuple, back.select(*names).collect()))
        assert got == sorted(map(tuple, flat.collect()))
        assert back.first().datetime == dt.datetime(2021, 3, 1)


def test_accounting_keeps_the_last_keys_of_each_level(spark):
    rows = [(s, t, g, "p", "c", 1) for s in ("S1", "S2", "S3") for t in "abc" for g in "xy"]
    base = spark.createDataFrame(
        rows, "site string, datatype string, datatype_grouped string, prod_step string, "
        "scope string, bytes bigint"
    )
    rest = "account campaign country cloud provenance experiment_site stream_name tier token"
    documents = base.withColumns(
        {c: F.lit("v") for c in rest.split()}
        | {
            "rse": F.when(F.col("datatype") == "c", "a_none_b").otherwise("disk"),
            "tombstone": F.when(F.col("site") == "S3", "UNKNOWN").otherwise("no"),
            "timestamp": F.lit(at(0)),
        }
    )
    got = gt.site_accounting(documents, "2021-02-01", "2021-02-02", keys_per_level=1).collect()
    assert [(r.site, r.datatype, r.datatypeg, r.bytes) for r in got] == [("S2", "b", "y", 1.0)]
