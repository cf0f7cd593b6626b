"""Aggregates by name, and the catalogue of report metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import MINUTE, TB, TIB, div


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_LOW_BITS = 22


def is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def exact_sum(c: Column | str) -> Column:
    """Integer sum beyond the range of bigint; 0 where every value is missing.

    High and low parts are summed as two bigints and put together once per group.
    That runs at the speed of a plain sum, about three times that of a decimal one,
    and is exact up to 2^41 rows per group and totals of 2^85. A value with a fraction
    is an error, never cut.
    """
    value = _col(c)
    whole = F.when(value == F.floor(value), value.cast("bigint")).when(
        value.isNotNull(), F.raise_error(F.lit("exact_sum of a value that is no whole number")).cast("bigint")
    )
    high = F.sum(F.shiftright(whole, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(whole.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    total = high * F.lit(1 << _LOW_BITS).cast("decimal(8,0)") + low
    return F.coalesce(total.cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)"))


def weighted_average(
    value: Column | str,
    weight: Column | str = "number_of_jobs",
    on_zero: str = "null",
    *,
    integral: bool = False,
) -> Column:
    """Sum(value * weight) / sum(weight) over the rows that have a value.

    A plain aggregate with map-side combine. With weights summing to zero the
    answer is NULL, or the plain mean with ``on_zero='mean'``. Whole-number values
    (``integral``) are summed exactly, others as doubles.
    """
    v, w = _col(value), _col(weight)
    product = exact_sum(v * w) if integral else F.sum(v.cast("double") * w)
    average = div(product, F.sum(F.when(v.isNotNull(), w)))
    return F.coalesce(average, F.avg(v)) if on_zero == "mean" else average


QUANTILES = {"median": 0.5, "q90": 0.9}

AGGREGATES = {
    "mean": lambda c, w, whole: F.avg(c),
    "sum": lambda c, w, whole: exact_sum(c) if whole else F.coalesce(F.sum(c), F.lit(0)),
    "median": lambda c, w, whole: F.median(c),
    "wavg": lambda c, w, whole: weighted_average(c, w, integral=whole),
    "q90": lambda c, w, whole: F.percentile(c, F.lit(0.9)),
    "nunique": lambda c, w, whole: F.countDistinct(c),
    "max": lambda c, w, whole: F.max(c),
    "min": lambda c, w, whole: F.min(c),
    "count": lambda c, w, whole: F.count(c),
}


def aggregate(
    how: str,
    column: Column | str,
    weight: Column | str = "number_of_jobs",
    *,
    integral: bool = False,
) -> Column:
    """The aggregate called ``how`` over ``column``; whole numbers add up exactly."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}; one of {sorted(AGGREGATES)}")
    return AGGREGATES[how](_col(column), _col(weight), integral)


@dataclass(frozen=True)
class Metric:
    """A report metric: site value, how cloud values follow from it, and unit."""

    name: str
    column: str
    how: str
    across_sites: str
    unit: float = 1
    inner_group: str | None = None
    weight: str = "number_of_jobs"


# The ten metrics of the utilisation report.
TASK = "jeditaskid"
REPORT_METRICS = [
    Metric("Total Number of Jobs", "number_of_jobs", "sum", "sum"),
    Metric("Jobs Waiting Time (minutes) per Task",
           "jobs_timetostart", "wavg", "mean", MINUTE, TASK),
    Metric("Jobs Execution Time (minutes) per Task",
           "jobs_total_duration", "wavg", "mean", MINUTE, TASK),
    Metric("Individual Analysis Users", "username", "nunique", "max"),
    Metric("Jobs Walltime (minutes) per Task",
           "jobs_total_walltime", "wavg", "mean", MINUTE, TASK),
    Metric("Jobs CPU Time (minutes) per Task",
           "jobs_cpuconsumptiontime", "wavg", "mean", MINUTE, TASK),
    Metric("Fraction of Task Attempt Execution Time",
           "fraction_of_attempt_duration", "wavg", "mean", 1, TASK),
    Metric("Total Input Data (TB)", "jobs_total_inputfilebytes", "sum", "sum", TIB),
    Metric("Total Output Data (TB)", "jobs_total_outputfilebytes", "sum", "sum", TIB),
    Metric("Max Input Volume per Task (TB)", "jobs_total_inputfilebytes", "max", "max", TIB),
]

# The nine metrics of the joined report.
JOINED_METRICS = [
    Metric("jobs_total_duration", "jobs_total_duration", "wavg", "mean", MINUTE),
    Metric("jobs_timetostart", "jobs_timetostart", "wavg", "mean", MINUTE),
    Metric("number_of_jobs", "number_of_jobs", "sum", "sum"),
    Metric("fraction_of_dataset", "fraction_of_dataset", "wavg", "mean"),
    Metric("jobs_total_walltime", "jobs_total_walltime", "wavg", "mean", MINUTE),
    Metric("jobs_cpuconsumptiontime", "jobs_cpuconsumptiontime", "wavg", "mean", MINUTE),
    Metric("jobs_total_inputfilebytes", "jobs_total_inputfilebytes", "sum", "sum", TB),
    Metric("jobs_total_outputfilebytes", "jobs_total_outputfilebytes", "sum", "sum", TB),
    Metric("fraction_of_attempt_duration", "fraction_of_attempt_duration", "mean", "mean"),
]


PARTS = 64


def first_of_each(df: DataFrame, group: list[str], order: Column, key: str, n: int) -> DataFrame:
    """The first n rows of each group in the given order of ``key``, unique in its group.

    They are ranked in parts by hash, then the first n of every part together, so no
    task sorts a whole group however large n is.
    """
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).alias("_part")
    in_part = Window.partitionBy(*group, "_part").orderBy(order)
    together = Window.partitionBy(*group).orderBy(order)
    some = df.select("*", part).withColumn("_rank", F.row_number().over(in_part))
    some = some.where(F.col("_rank") <= n).withColumn("_rank", F.row_number().over(together))
    return some.where(F.col("_rank") <= n).drop("_rank", "_part")


STEPS = 16
RANGES = STEPS * STEPS
#: Rank error of the splitters, as one part in so many.
SPLIT_ACCURACY = 5000


def quantiles(
    df: DataFrame, keys: list[str], column: str, wanted: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group; the keys must not be missing.

    Rows are first counted per (group, value) with map-side combine.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v"))
    return counted_quantiles(counted.agg(F.count(F.lit(1)).alias("_n")), keys, wanted)


def equal_ranges(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, _v, ...) with ``_range``, 0 to 255 in the order of the group's values, and ``_total``.

    The splitters are quantiles of the group's values from a mergeable sketch, so the ranges
    hold about equally many rows however the values are spread. The splitters at or below a
    value are counted in two steps of 15 comparisons.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    spans = counted.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, SPLIT_ACCURACY).alias("_cuts"), F.sum("_n").alias("_total")
    )

    def reached(places: list) -> Column:
        return sum(((F.col("_v") >= F.get("_cuts", at)).cast("int") for at in places), F.lit(0))

    coarse = reached([F.lit(STEPS * i - 1) for i in range(1, STEPS)])
    fine = reached([F.col("_coarse") * STEPS + i for i in range(STEPS - 1)])
    rows = counted.join(spans, keys).withColumn("_coarse", coarse)
    return rows.withColumn("_range", F.col("_coarse") * STEPS + fine).drop("_cuts", "_coarse")


def counted_quantiles(counted: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """The same from rows (keys, _v, _n): a value of the group and how often it occurs.

    A group's values are cut into ranges of about equally many. Running counts over the
    ranges tell in which ones the wanted positions lie, and only those are sorted, so no
    task holds all values of a group.
    """
    rows = equal_ranges(counted, keys)
    position = {name: (F.col("_total") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    held = F.lit(False)
    for p in position.values():
        for at in (F.floor(p), F.ceil(p)):
            held |= (at >= F.col("_before")) & (at < F.col("_before") + F.col("_count"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy(*keys, "_range", "_total")
        .agg(F.sum("_n").alias("_count"))
        .withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
        .where(held)
        .select(*keys, "_range", "_before")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    sorted_rows = rows.join(ranges, [*keys, "_range"]).withColumn(
        "_at", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )

    def value(p: Column) -> Column:
        here = (p >= F.col("_at")) & (p < F.col("_at") + F.col("_n"))
        return F.max(F.when(here, F.col("_v"))).cast("double")

    ends = [
        part
        for j, p in enumerate(position.values())
        for part in (value(F.floor(p)).alias(f"_low{j}"), value(F.ceil(p)).alias(f"_high{j}"))
    ]
    found = sorted_rows.groupBy(*keys, "_total").agg(*ends)
    between = [
        F.when(F.floor(p) == F.ceil(p), F.col(f"_low{j}"))
        .otherwise((F.ceil(p) - p) * F.col(f"_low{j}") + (p - F.floor(p)) * F.col(f"_high{j}"))
        .alias(name)
        for j, (name, p) in enumerate(position.items())
    ]
    return found.select(*keys, *between)
