"""Readers, writers and the batch write."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

import gridtally as gt
from gridtally.sources import files, sinks, upsert, workspace
from gridtally.streaming import hourly

DDL = "jeditaskid bigint, name string, started timestamp_ntz"


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def table(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_round_trip(spark, folder):
    df = table(spark, [(1, 'a "quoted", name', dt.datetime(2021, 2, 1, 3, 4, 5)), (2, None, None)])
    files.write_csv(df, folder)
    assert rows_of(files.read_csv(spark, folder, DDL)) == rows_of(df)


def test_csv_layouts_by_name(spark, folder):
    files.write_csv(table(spark, [(1, "a")], "jeditaskid bigint, name string"), f"{folder}/x")
    files.write_csv(table(spark, [("q", 2)], "queue string, jeditaskid bigint"), f"{folder}/y")
    got = files.read_csv_layouts(
        spark,
        [f"{folder}/x/*.csv", f"{folder}/y/*.csv"],
        "jeditaskid bigint, name string, queue string",
    )
    assert rows_of(got) == [(1, "a", None), (2, None, "q")]


def test_csv_by_name(spark, folder):
    lines = [",started,jeditaskid,n", "0,2021-02-01 03:00:00,12345678901,3.0", "1,,,"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    got = files.read_csv_by_name(
        spark, folder, "jeditaskid bigint, n tinyint, started timestamp_ntz, gone string"
    )
    assert rows_of(got) == sorted(
        [(12345678901, 3, dt.datetime(2021, 2, 1, 3), None), (None, None, None, None)], key=repr
    )
    with pytest.raises(Exception):  # by position the header must match
        files.read_csv(spark, folder, "jeditaskid bigint, a string, b string, c string").collect()


def test_bad_lines(spark, folder):
    lines = ["jeditaskid,name", "1,a", "2,b,surplus", "3"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    ddl = "jeditaskid bigint, name string"
    got = files.read_csv(spark, folder, ddl, drop_bad_lines=True)
    assert rows_of(got) == [(1, "a"), (3, None)]
    assert got.count() == 2  # whichever columns are read
    assert got.select("jeditaskid").count() == 2
    lines = ["jeditaskid,a,b", "1,x,", "1,x,,", "1,x,,,5", '2,"p,q",z', "3"]
    wide = "jeditaskid bigint, a string, b string"
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}-2")
    got = files.read_csv(spark, f"{folder}-2", wide, drop_bad_lines=True)
    assert rows_of(got) == sorted([(1, "x", None), (2, "p,q", "z"), (3, None, None)], key=repr)
    spark.createDataFrame([("jeditaskid,name",), ("abc,x",)], "value string").coalesce(1).write.text(f"{folder}-3")
    with pytest.raises(Exception, match="does not fit its type"):
        files.read_csv(spark, f"{folder}-3", ddl, drop_bad_lines=True).collect()
    with pytest.raises(Exception):
        stream = hourly.read_hourly(spark, f"{folder}-3", ddl)
        hourly.start(stream, f"{folder}-log", f"{folder}-cp").awaitTermination()
    with pytest.raises(Exception):
        files.read_csv(spark, folder, ddl).collect()


def test_report_folders(spark, folder):
    df = table(
        spark, [("r", "C 1", "m", 1.0), ("r", "C2", "m", 2.0)],
        "report string, split string, metric string, value double",
    )
    sinks.write_report(df, folder)
    assert rows_of(spark.read.parquet(folder).select(*df.columns)) == rows_of(df)
    only = spark.read.parquet(folder).where("split = 'C2'")
    assert "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().toString()


def test_month_folders_are_pruned(spark, folder):
    days = [dt.datetime(2021, m, 15) for m in (1, 2, 3, 12)] + [None]
    df = table(spark, [(i, d) for i, d in enumerate(days)], "i int, task_modificationtime timestamp_ntz")
    files.write_log(df, folder)
    got = files.read_log(spark, folder, "2021-02-01 00:00:00", "2021-03-15 00:00:00", ["i"])
    assert rows_of(got) == [(1,), (2,)]
    assert "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().toString()


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get(workspace.SETTING, None) or spark.sparkContext.getCheckpointDir()
    assert workspace.shared_folder(spark) == named
    assert workspace.fresh_path(spark, "x") != workspace.fresh_path(spark, "x")


def test_replace_by_task(spark):
    target = table(spark, [(1, "old", None), (1, "old2", None), (2, "kept", None), (None, "n", None)])
    batch = table(spark, [(1, "new", None), (3, "added", None)])
    once = gt.replace_by_task(target, batch)
    wanted = [(1, "new"), (2, "kept"), (3, "added"), (None, "n")]
    assert rows_of(once.select("jeditaskid", "name")) == sorted(wanted, key=repr)
    assert rows_of(gt.replace_by_task(once, batch)) == rows_of(once)


def test_clean_batch(spark):
    df = spark.createDataFrame(
        [
            (float("nan"), "[{'site':'A','n':2}]"),
            (1.5, "[{'site'"),
            (2.0, "({'site': \"O'Neil (None)\", 'n': None},)"),
            (2.5, "[{'site': 'say \\'hi\\', \"True\"', 'n': 3,},]"),
            (3.0, None),
        ],
        "x double, ds_replicas_info string",
    )
    got = gt.clean_batch(df, "array<struct<site:string,n:bigint>>").collect()
    assert [r.x for r in got] == [None, 1.5, 2.0, 2.5, 3.0]
    found = [[(e.site, e.n) for e in r.ds_replicas_info or ()] for r in got]
    assert found == [[("A", 2)], [], [("O'Neil (None)", None)], [("say 'hi', \"True\"", 3)], []]
    assert [r.ds_replicas_info_unread for r in got] == [None, "[{'site'", None, None, None]
    assert [r.ds_replicas_info for r in gt.clean_batch(df).collect()][1] == "[{'site'"


def test_document_ids(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    ids = [r.i for r in df.select(upsert.document_id(["x", "y"]).alias("i")).collect()]
    assert ids[0] == ids[2] != ids[1]
    assert len(ids[0]) == 64


def test_keyed_documents_keep_the_first_in_order(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, v int")
    kept = gt.keyed_documents(df, [F.desc("v")], ["k"])
    assert rows_of(kept.select("k", "v")) == [(1, 7), (2, 1)]


def test_hourly_stream_equals_repeated_replacement(spark, folder):
    ddl = "jeditaskid bigint, name string"
    batches = [[(1, "a"), (2, "b")], [(2, "b2"), (3, "c")], [(1, "a3")]]
    target = spark.createDataFrame([], ddl)
    for rows in batches:
        batch = spark.createDataFrame(rows, ddl)
        target = gt.replace_by_task(target, batch)
        files.write_csv(batch, f"{folder}/in", mode="append")
        stream = hourly.read_hourly(spark, f"{folder}/in", ddl)
        hourly.start(stream, f"{folder}/log", f"{folder}/cp").awaitTermination()
    current = hourly.current_records(spark.read.parquet(f"{folder}/log"))
    assert rows_of(current.select("jeditaskid", "name")) == rows_of(target)
    # a batch written again changes nothing
    hourly.append_batch(f"{folder}/log")(spark.createDataFrame(batches[2], ddl), 2)
    again = hourly.current_records(spark.read.parquet(f"{folder}/log"))
    assert rows_of(again.select("jeditaskid", "name")) == rows_of(target)
    # nor does compaction, which leaves one older batch
    loose = spark.createDataFrame([(None, "loose")], ddl)
    hourly.append_batch(f"{folder}/log")(loose, 3)
    hourly.append_batch(f"{folder}/log")(spark.createDataFrame([(3, "c4")], ddl), 4)
    before = rows_of(hourly.current_records(spark.read.parquet(f"{folder}/log")))
    for _ in range(2):
        hourly.compact(spark, f"{folder}/log")
        log = spark.read.parquet(f"{folder}/log")
        assert rows_of(hourly.current_records(log)) == before
        assert {r.batch_id for r in log.select("batch_id").distinct().collect()} == {3, 4}


def test_replace_in_log_rewrites_touched_months(spark, folder):
    def day(m):
        return dt.datetime(2021, m, 5)

    ddl = "jeditaskid bigint, name string, task_modificationtime timestamp_ntz"
    old = [(1, "a", day(1)), (2, "b", day(2)), (3, "c", day(3)), (4, "d", day(3)), (5, "e", None)]
    files.write_log(spark.createDataFrame(old, ddl), folder)
    batch = [(2, "b2", day(4)), (3, "c2", day(3)), (5, "e2", day(4))]
    for _ in range(2):
        files.replace_in_log(spark, folder, spark.createDataFrame(batch, ddl))
        got = spark.read.parquet(folder).select("jeditaskid", "name")
        assert rows_of(got) == [(1, "a"), (2, "b2"), (3, "c2"), (4, "d"), (5, "e2")]


def test_json_records(spark, folder):
    df = table(spark, [(1, "a", dt.datetime(2021, 2, 1)), (2, None, None)])
    docs = [r.doc for r in files.to_json_records(df).collect()]
    assert docs[1] == '{"jeditaskid":2}'
    files.write_json(df, folder)
    assert rows_of(spark.read.schema(DDL).json(folder)) == rows_of(df)


def test_rejects_and_rows_equal_the_lines(spark, folder):
    ddl = "jeditaskid bigint, name string, started timestamp_ntz"
    good = ['1,"a, ""b""",2021-02-01 00:00:00', "2,,", "3", '4,"x\t"', "5,y,2021-02-01 10:00:00"]
    bad = {
        "x,y,2021-02-01 00:00:00": "jeditaskid is no bigint",
        "6,y,soon": "started is no timestamp_ntz",
        "7,y,2021-02-01 00:00:00,more": "4 fields instead of 3",
        '8,"a,b",,': "4 fields instead of 3",
        "1.5": "jeditaskid is no bigint",
        "99999999999999999999,y,": "jeditaskid is no bigint",
    }
    lines = [*good, *bad, ""]
    for part in (lines[:4], lines[4:]):
        spark.createDataFrame([(x,) for x in part], "v string").coalesce(1).write.mode("append").text(f"{folder}/in")
    judged = files.read_csv_judged(spark.read, f"{folder}/in", ddl, header=False)
    rejects = files.rejected(judged).collect()
    assert {r.text: r.reason for r in rejects} == bad
    assert all(folder in r.file for r in rejects)
    rows = rows_of(files.accepted(judged))
    assert [r[:2] for r in rows] == [(1, 'a, "b"'), (2, None), (3, None), (4, "x\t"), (5, "y")]
    assert judged.count() == len(good) + len(bad)
    stream = files.read_csv_judged(spark.readStream, f"{folder}/in", ddl, header=False)
    for _ in range(2):
        hourly.start(stream, f"{folder}/log", f"{folder}/cp", rejects_path=f"{folder}/rejects").awaitTermination()
    assert rows_of(spark.read.parquet(f"{folder}/log").drop("batch_id")) == rows
    assert {r.text: r.reason for r in spark.read.parquet(f"{folder}/rejects").collect()} == bad


def test_rejects_with_a_header(spark, folder):
    spark.createDataFrame([("jeditaskid,name",), ("1,a",), ("b,c",)], "v string").coalesce(1).write.text(folder)
    judged = files.read_csv_judged(spark.read, folder, "jeditaskid bigint, name string")
    assert rows_of(files.accepted(judged)) == [(1, "a")]
    assert [(r.text, r.reason) for r in files.rejected(judged).collect()] == [("b,c", "jeditaskid is no bigint")]


def scanned_rows(df):
    """Rows that the file scans of a finished query handed on."""
    df.collect()
    found, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            waiting.append(node.plan())
        elif name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return found


def test_lookups_leave_most_of_a_clustered_log_unread(spark, folder):
    minutes = F.lit(dt.datetime(2021, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.pmod(F.col("id") * 7919, F.lit(90 * 1440)).cast("int"))
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)))
    rows = spark.range(300_000).select(
        "id",
        F.concat(F.lit("d"), hot).alias("datasetname"),
        F.xxhash64("id", F.lit(5)).alias("jeditaskid"),
        minutes.alias("task_modificationtime"),
    )
    rows = rows.cache()
    files.write_log(rows, f"{folder}/months")
    files.write_clustered_log(rows, f"{folder}/clustered", row_group=500)
    week = ("2021-02-08 00:00:00", "2021-02-15 00:00:00")
    for name in ("d7", "d0"):
        found = {}
        for layout in ("months", "clustered"):
            path = f"{folder}/{layout}"
            got = files.read_log(spark, path, *week, rows.columns, equal={"datasetname": name})
            found[layout] = scanned_rows(got), rows_of(got)
        assert found["months"][1] == rows_of(
            rows.where((F.col("datasetname") == name) & F.col("task_modificationtime").between(*week))
        )
        assert found["months"][1] == found["clustered"][1] and found["months"][1]
        print(name, "rows scanned by month", found["months"][0], "clustered", found["clustered"][0], "wanted", len(found["months"][1]))
        assert found["clustered"][0] < 0.4 * found["months"][0]
    task = rows.where("id = 12345").first().jeditaskid
    got = files.read_log(spark, f"{folder}/clustered", "2021-01-01 00:00:00", "2021-04-30 00:00:00", ["id"], equal={"jeditaskid": task})
    assert scanned_rows(got) < 0.2 * rows.count() and rows_of(got) == [(12345,)]
