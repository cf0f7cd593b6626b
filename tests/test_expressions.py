"""Scalar and interval rules on literal rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridtally import schema
from gridtally.functions import intervals, literals, measures, predicates, scalars

DAY = dt.datetime(2021, 2, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def values(df, column):
    return [r[column] for r in df.collect()]


def buckets(spark, offsets, n):
    df = spark.createDataFrame([(at(o),) for o in offsets], "t timestamp_ntz")
    index, df = intervals.interval_index(df, "t", intervals.time_bounds(df, "t"), n)
    return values(df.select(index.alias("i")), "i")


def test_bucket_edges(spark):
    # interval 1 of four over 80 seconds starts at 20; the last record is in none
    assert buckets(spark, [0, 19, 20, 79, 80], 4) == [0, 0, 1, 3, None]


def test_single_time_has_no_bucket(spark):
    assert buckets(spark, [5, 5], 8) == [None, None]


@pytest.mark.parametrize("n", [4, 5, 8, 10])
def test_buckets_match_their_definition(spark, n):
    rng = random.Random(n)
    for span in (1, 3, 7, 61, 1000, 86399):
        offsets = [0, span] + [rng.randint(0, span) for _ in range(40)]
        starts = [k * span // n for k in range(n)] + [span]
        wanted = []
        for o in offsets:
            holds = [k for k in range(n) if starts[k] <= o < starts[k + 1]]
            wanted.append(holds[0] if holds else None)
        assert buckets(spark, offsets, n) == wanted


def test_bucket_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Zurich")
    try:
        # the clock change of that night must not move a boundary
        rows = [(dt.datetime(2021, 3, 28, h),) for h in range(0, 9)]
        df = spark.createDataFrame(rows, "t timestamp_ntz")
        index, df = intervals.interval_index(df, "t", intervals.time_bounds(df, "t"), 4)
        assert values(df.select(index.alias("i")), "i") == [0, 0, 1, 1, 2, 2, 3, 3, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_weights(spark):
    rows = spark.range(1).select(
        *[
            intervals.recency_weight(k, 4, scheme).alias(f"{scheme}_{k}")
            for scheme in intervals.WEIGHT_SCHEMES
            for k in (0, 3)
        ]
    )
    r = rows.first()
    assert (r.newest_one_0, r.newest_one_3) == (0.125, 1.0)
    assert (r.newest_half_0, r.newest_half_3) == (0.0625, 0.5)
    assert (r.linear_0, r.linear_3) == (0.2, 0.8)
    assert r.exponential_0 == pytest.approx(2.718281828459045**-0.2)
    with pytest.raises(ValueError):
        intervals.recency_weight(0, 4, "flat")


@pytest.mark.parametrize(
    "rows, wanted",
    [
        ([(1, 3), (2, 4)], 4),
        ([(2, 4), (2, 5)], 5),  # same second: the larger
        ([(2, None), (1, 3)], None),  # the latest is missing
        ([(2, None), (2, 3)], 3),
        ([(None, 9), (1, 3)], 3),  # no time is never the latest
        ([(-9 * 10**9, -128), (-9 * 10**9 - 1, 127)], -128),  # long before 1970
    ],
)
def test_latest_value(spark, rows, wanted):
    data = [(None if s is None else at(s), v) for s, v in rows]
    df = spark.createDataFrame(data, "t timestamp_ntz, v tinyint")
    code = intervals.latest_code("v", "t", df.schema["v"].dataType)
    assert df.agg(F.max(code).alias("c")).select(
        intervals.latest_value(F.col("c")).alias("v")
    ).first().v == wanted


def test_latest_value_of_wider_types(spark):
    df = spark.createDataFrame([(at(1), 40000), (at(2), -40000), (at(0), None)], "t timestamp_ntz, v int")
    code = intervals.latest_code("v", "t", df.schema["v"].dataType)
    got = df.agg(F.max(code).alias("c")).select(intervals.latest_value(F.col("c")).alias("v"))
    assert got.first().v == -40000
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(at(1), 5_000_000)], df.schema).agg(F.max(code)).collect()
    with pytest.raises(TypeError):
        intervals.latest_code("x", "t", schema.T.DoubleType())


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.25,), (0.35,)], "x double")
    assert values(df.select(scalars.round_even("x").alias("y")), "y") == [0, 2, 2, 0, 0]
    assert values(df.select(scalars.round_even_1("x").alias("y")), "y") == [0.5, 1.5, 2.5, 0.2, 0.4]
    base = spark.createDataFrame([(12.5,), (7.5,), (7.4,)], "x double")
    assert values(base.select(scalars.round_to_base("x").alias("y")), "y") == [10, 10, 5]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (None, 2)], "x int, y int")
    assert values(df.select(scalars.div("x", "y").alias("z")), "z") == [None, 0.5, None]


def test_queue_time_wraps_within_a_day(spark):
    df = spark.createDataFrame(
        [(at(0), at(60)), (at(90), at(0))], "created timestamp_ntz, started timestamp_ntz"
    )
    got = values(df.select(scalars.queue_time("created", "started").alias("q")), "q")
    assert got == [(86400 - 60) / 60, 1.5]


def test_cap_comes_before_floor(spark):
    df = spark.createDataFrame(
        [(3.0, 2), (3.0, 0), (0.0, 5), (2.0, 2), (None, 4)], "o double, a bigint"
    )
    got = values(df.select(scalars.cap_then_floor(F.col("o"), F.col("a")).alias("r")), "r")
    assert got == [2.0, 1.0, 1.0, 2.0, None]


def test_verdict_is_false_when_unknown(spark):
    df = spark.createDataFrame(
        [(5, 2, 1.0), (2, 5, 1.0), (5, 2, 0.0), (None, 2, 1.0)], "nx bigint, c bigint, d double"
    )
    got = df.select(scalars.verdict(F.col("nx"), F.col("c"), F.col("d")).alias("v"))
    assert values(got, "v") == [True, False, False, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("SUSY15a2", "A", "B,A"), (None, "A", None)], "t string, s string, l string")
    assert values(df.select(scalars.strip_digits("t").alias("x")), "x") == ["SUSYa", None]
    assert values(df.select(scalars.site_is_replica("s", "l").alias("x")), "x") == [True, None]


def test_audience_weight(spark):
    df = spark.createDataFrame([(5,), (0,)], "u bigint")
    got = values(df.select(scalars.audience_weight(F.col("u")).alias("w")), "w")
    assert got[0] == 0.5
    assert got[1] == pytest.approx(1 / (1 + 2.718281828459045**5))


def test_weighted_average(spark):
    df = spark.createDataFrame(
        [("a", 10, 1), ("a", 20, 3), ("a", None, 9), ("b", 4, 0), ("b", 8, 0), ("c", None, 2)],
        "g string, v bigint, w bigint",
    )
    plain = df.groupBy("g").agg(measures.weighted_average("v", "w").alias("x")).orderBy("g")
    assert values(plain, "x") == [17.5, None, None]
    mean = df.groupBy("g").agg(measures.weighted_average("v", "w", "mean").alias("x")).orderBy("g")
    assert values(mean, "x") == [17.5, 6.0, None]


def test_aggregates_by_name(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (4, 2), (None, 1)], "v bigint, number_of_jobs bigint")
    got = df.agg(*[measures.aggregate(h, "v").alias(h) for h in measures.AGGREGATES]).first()
    assert (got["sum"], got["max"], got["min"], got["count"], got["nunique"]) == (7, 4, 1, 3, 3)
    assert (got["median"], got["wavg"]) == (2.0, 2.75)
    assert got["q90"] == pytest.approx(3.6)
    assert got["mean"] == pytest.approx(7 / 3)
    none = spark.createDataFrame([(None, 1)], "v bigint, number_of_jobs bigint")
    assert none.agg(measures.aggregate("sum", "v").alias("s")).first().s == 0
    with pytest.raises(ValueError):
        measures.aggregate(" q90", "v")


def test_quantiles_equal_the_plain_aggregate(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(20)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = measures.quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}).orderBy("g").collect()
    want = df.groupBy("g").agg(F.median("v"), F.percentile("v", F.lit(0.9))).orderBy("g").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


@pytest.mark.parametrize("kind", ["double", "bigint", "decimal(20,3)"])
def test_ranges_of_skewed_values_hold_equally_many(spark, kind):
    values = F.exp(F.randn(5) * 3).cast(kind) if kind != "bigint" else F.exp(F.randn(5) * 3 + 20).cast(kind)
    rows = spark.range(400_000).select((F.col("id") % 4 == 0).alias("g"), values.alias("v"))
    counted = rows.groupBy("g", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).cache()
    placed = measures.equal_ranges(counted, ["g"])
    sizes = placed.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    groups = {r.g: r.n for r in counted.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_group = {g: sorted((r._range, r.n, r.lo, r.hi) for r in sizes.collect() if r.g == g) for g in groups}
    for g, ranges in by_group.items():
        assert max(n for _, n, _, _ in ranges) < 0.02 * groups[g]
        assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:]))
        assert 0 <= ranges[0][0] and ranges[-1][0] < measures.RANGES
    got = measures.counted_quantiles(counted, ["g"], {"m": 0.5, "q": 0.9}).orderBy("g").collect()
    plain = F.col("_v").cast("double")
    want = counted.groupBy("g").agg(F.percentile(plain, F.lit(0.5), F.col("_n")), F.percentile(plain, F.lit(0.9), F.col("_n")))
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want.orderBy("g").collect()]


def test_exact_sum_beyond_bigint(spark):
    rng = random.Random(4)
    cases = [
        [2**62] * 4,
        [2**63 - 1, -(2**63), -1, 0],
        [-(2**62)] * 5 + [None],
        [rng.randint(-(2**63), 2**63 - 1) for _ in range(200)],
        [None],
    ]
    for case in cases:
        df = spark.createDataFrame([(v,) for v in case], "b bigint")
        got = df.agg(measures.exact_sum("b").alias("s")).first().s
        assert int(got) == sum(v for v in case if v is not None)


def test_queue_and_scope_filters(spark):
    df = spark.createDataFrame(
        [("ANALY_GPU", "mc16_13TeV"), ("x_gpu", None), (None, "mc15_5TeV"), ("CPU", "a_13TeV")],
        "queue string, ds_scope string",
    )
    assert df.where(predicates.not_gpu()).count() == 2
    assert df.where(predicates.in_13tev()).count() == 2


def test_training_rows(spark):
    df = spark.createDataFrame(
        [("TOPQ1", "good"), ("TOPQ1", "a_debug"), ("SUSY1", "good"), ("TOPQ1", "calibration")],
        "ds_data_type_desc string, datasetname string",
    )
    assert df.where(predicates.training_rows("TOPQ")).count() == 1


def test_declared_schema_counts(spark):
    fields = schema.declared_schema()
    assert len(fields) == 89
    kinds = {}
    for f in fields:
        kinds[f.dataType.simpleString()[:13]] = kinds.get(f.dataType.simpleString()[:13], 0) + 1
    assert kinds["timestamp_ntz"] == 17
    assert (kinds["bigint"], kinds["smallint"], kinds["tinyint"], kinds["double"]) == (27, 5, 2, 2)
    assert kinds["string"] == 19 + 14 + 1
    spark.createDataFrame([], fields)


def read_back(spark, texts, schema):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, info string")
    found = literals.read_literals(rows, "info", schema).orderBy("id").collect()
    return [(r["info"].asDict(True) if hasattr(r["info"], "asDict") else r["info"], r["info_unread"]) for r in found]


PAIR = "struct<a:bigint,b:string>"
FITTING = {
    "{'a': 1, 'b': 'q'}": (1, "q"),
    "{'b': None}": (None, None),
    "{}": (None, None),
    "{'a': 1, 'b': \"it's\"}": (1, "it's"),
    r"{'a': 1, 'b': 'x\\'}": (1, "x\\"),
    r"""{"a": 1, "b": "x\\'y"}""": (1, "x\\'y"),
    r"""{'a': 1, 'b': 'say \"hi\" \\\" "x" \x41\x42 \'z\''}""": (1, 'say "hi" \\" "x" AB \'z\''),
    "{'a': -7, 'b': 'None, True (x) ,]'}": (-7, "None, True (x) ,]"),
    "{'a': 3, 'b': 5}": (3, "5"),
}
MISFITS = {
    "{'a': 'x'": None,
    "{'a': 'x'}": (None, None),
    "{'a': 1.7}": (None, None),
    "{'a': '12', 'b': 'k'}": (None, "k"),
    "{'a': 99999999999999999999}": (None, None),
    "{'a': 2, 'c': 5}": (2, None),
    "{'a': 1}'": None,
    "{'a': 1, 'a': 2}": None,
    "{1: 'a'}": None,
    "(1, 2)": None,
    "'text'": None,
    "": None,
}


def as_pair(value):
    return None if value is None else {"a": value[0], "b": value[1]}


def test_literals_that_fit_leave_no_text(spark):
    assert read_back(spark, FITTING, PAIR) == [(as_pair(v), None) for v in FITTING.values()]
    assert read_back(spark, [None, "None"], PAIR) == [(None, None), (None, None)]


def test_literals_that_do_not_fit_keep_their_text_at_any_depth(spark):
    assert read_back(spark, MISFITS, PAIR) == [(as_pair(v), t) for t, v in MISFITS.items()]
    whole = {t: v for t, v in MISFITS.items() if v is not None}
    for left, right, schema, wrap in (
        ("[", ",]", f"array<{PAIR}>", lambda v: [v]),
        ("{'k': ", "}", f"map<string,{PAIR}>", lambda v: {"k": v}),
        ("[[", "], []]", f"array<array<{PAIR}>>", lambda v: [[v], []]),
    ):
        texts = [left + t + right for t in whole]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, info string")
        found = literals.read_literals(rows, "info", schema).orderBy("id").collect()
        assert [(r.asDict(True)["info"], r["info_unread"]) for r in found] == [
            (wrap(as_pair(v)), t) for v, t in zip(whole.values(), texts, strict=True)
        ]


def test_literals_of_other_types(spark):
    schema = "struct<d:double,f:boolean,t:timestamp_ntz,m:decimal(6,2)>"
    texts = [
        "{'d': 1.5, 'f': True, 't': '2021-02-01 00:00:00', 'm': 12.25}",
        "{'d': 'x', 'f': 1, 't': 'soon', 'm': 12.255}",
        "{'d': 2, 'f': None}",
    ]
    noon = dt.datetime(2021, 2, 1)
    (good, none, part) = read_back(spark, texts, schema)
    assert good == ({"d": 1.5, "f": True, "t": noon, "m": Decimal("12.25")}, None)
    assert none == ({"d": None, "f": None, "t": None, "m": None}, texts[1])
    assert part == ({"d": 2.0, "f": None, "t": None, "m": None}, None)


def test_literal_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([("{'a': 1}", 5, "x")], "info string, _variant int, `odd name` string")
    out = literals.read_literals(rows, "info", PAIR)
    assert out.columns == ["info", "_variant", "odd name", "info_unread"]
    assert out.first()["_variant"] == 5
    odd = literals.read_literals(rows.withColumnRenamed("info", "in.fo"), "in.fo", PAIR)
    assert odd.first()["in.fo"]["a"] == 1


def test_literals_by_parts_and_as_a_whole_are_the_same(spark):
    """Texts with one kind of quotes are rewritten as a whole, others part by part."""
    texts = [
        "{'a': None, 'b': (1, 2,), 'None': 'None, (True) ,]', }",
        "[True, False, None, xNone, Nonex, 'x', None]",
        "('a,)', (None,) , 'b' ,  )",
        '{"a": [1, 2 , ], "True": "(False,)"}',
        "None",
        "()",
        "",
        "['it\n, ]', None]",
        "{'a': 'open}",
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    # A list around each of them with a text that has both kinds of quotes.
    mixed = F.concat(F.lit("[\"it's\","), F.col("t"), F.lit("]"))
    found = rows.select("t", literals.literal_as_json("t").alias("whole"), literals.literal_as_json(mixed).alias("parts")).collect()
    assert [r.whole is None for r in found] == [False] * 8 + [True]
    for r in found[:2] + found[3:6]:
        assert r.parts == f'["it\'s",{r.whole}]'
    assert found[0].whole == '{"a": null, "b": [1, 2], "None": "None, (True) ,]"}'
    assert found[1].whole == '[true, false, null, xNone, Nonex, "x", null]'
    assert found[2].whole == '["a,)", [null] , "b" ]'
    assert found[7].whole == '["it\n, ]", null]'


def test_long_literals_are_read(spark):
    """A quoted text is matched without a step of recursion for each of its characters."""
    rows = spark.range(1).select(F.concat(F.lit("{'a': 1, 'b': '"), F.repeat(F.lit("it\\'s "), 20000), F.lit("'}")).alias("t"))
    got = literals.read_literals(rows, "t", "struct<a:bigint,b:string>").selectExpr("t.a", "length(t.b) n", "t_unread").first()
    assert (got.a, got.n, got.t_unread) == (1, 100000, None)


def test_values_of_the_declared_kinds_are_taken_at_once(spark):
    """Exactly declared kinds and all others give what reading field by field gives."""
    kind = "array<struct<b:string,a:bigint>>"
    texts = ["[{'a': 1, 'b': 'x'}]", "[{'a': None, 'b': 'x'}, None]", "[{'a': 1}]", "[]", "[{'a': 1, 'b': 'x', 'c': 2}]", "[{'a': 1.5, 'b': 2}]", "{'a': 1, 'b': 'x'}", "[{'a': 9223372036854775808, 'b': 'x'}]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    declared = literals.T._parse_datatype_string(kind)
    v = F.try_parse_json(literals.literal_as_json("t"))
    both = rows.select(v.alias("v")).select(literals._judged(F.col("v"), declared).alias("x"), literals._read(F.col("v"), declared).alias("y"))
    found = both.collect()
    assert all(r.x == r.y for r in found)
    assert [r.x.fits for r in found] == [True, True, True, True, False, False, False, False]
