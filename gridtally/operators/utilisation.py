"""Utilisation reports: metrics per site, and per cloud over its sites.

Reports are long tables ``(.., metric, value)``. ``pivot_wide`` turns one into the
printed layout when the columns are known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.days import DAY, INSTANT, read_states, with_day, write_states
from ..functions.lookbacks import LOOKBACK_DAYS, band, lookbacks_of, within_longest
from ..functions.measures import (
    QUANTILES,
    REPORT_METRICS,
    Metric,
    aggregate,
    counted_quantiles,
    exact_sum,
    first_of_each,
    is_whole,
    quantiles,
)
from ..functions.predicates import not_null
from ..functions.scalars import div, fraction, round_even_1, strip_digits

SPLIT, LEVEL = "site_cloud", "site_name"


def with_fractions(df: DataFrame, scale: float = 1) -> DataFrame:
    """Add the two ratio columns and strip digits from the type name.

    Durations and bytes keep their whole units here and are converted after the
    sum. ``scale=60`` gives the attempt fraction of the reports that divide the
    attempt's duration by sixty twice.
    """
    return df.withColumns(
        {
            "fraction_of_dataset": div("jobs_primary_input_fsize", "ds_bytes"),
            "fraction_of_attempt_duration": fraction(
                "jobs_total_duration", "attempt_total_duration", scale
            ),
            "ds_data_type_desc": strip_digits("ds_data_type_desc"),
        }
    )


# --- metrics in two steps: partial states, then their merge -----------------


def _states(m: Metric, j: int, whole: bool) -> dict[str, tuple[Column, Column]]:
    """State columns of a metric: how each begins and how it merges.

    Whole numbers add up exactly, others as doubles.
    """
    value = F.col(m.column)
    total = exact_sum if whole else (lambda c: F.sum(c.cast("double")))
    if m.how == "sum":
        return {f"s{j}": (F.coalesce(total(value), F.lit(0)), F.sum(f"s{j}"))}
    if m.how in ("max", "min"):
        keep = F.max if m.how == "max" else F.min
        return {f"m{j}": (keep(value), keep(f"m{j}"))}
    if m.how == "count":
        return {f"c{j}": (F.count(value), F.sum(f"c{j}"))}
    if m.how == "mean":
        return {
            f"s{j}": (total(value), F.sum(f"s{j}")),
            f"c{j}": (F.count(value), F.sum(f"c{j}")),
        }
    if m.how == "wavg":
        if m.inner_group:
            value = F.when(F.col(m.inner_group).isNotNull(), value)
        weight = F.col(m.weight)
        return {
            f"s{j}": (total(value * weight), F.sum(f"s{j}")),
            f"c{j}": (F.sum(F.when(value.isNotNull(), weight)), F.sum(f"c{j}")),
        }
    if m.how == "nunique":
        return {f"d{j}": (None, F.countDistinct(m.column))}
    raise ValueError(f"{m.how} of {m.name} cannot be merged from partial results")


def _value(m: Metric, j: int) -> Column:
    if m.how in ("mean", "wavg"):
        value = div(f"s{j}", f"c{j}")
    else:
        state = {"sum": "s", "max": "m", "min": "m", "count": "c", "nunique": "d", **dict.fromkeys(QUANTILES, "q")}
        value = F.col(state[m.how] + str(j)).cast("double")
    return value if m.unit == 1 else value / F.lit(float(m.unit))


def site_metrics(
    df: DataFrame,
    metrics: list[Metric] = REPORT_METRICS,
    *,
    by: tuple[str, ...] = ("ds_scope",),
    split: str = SPLIT,
    level: str = LEVEL,
    as_of: str | None = None,
    lookbacks: dict[str, int] | None = None,
    time_col: str = "task_modificationtime",
) -> DataFrame:
    """One row per (by, cloud, site), one column per metric, unrounded.

    With ``as_of``, one such set per look-back (column ``lookback``), from a single
    pass: records are first reduced per group, distinct-counted value and time
    band, and only those rows are copied into the look-backs that include their
    band. The first reduction also spreads a hot site over its users. Quantiles are
    taken from counted values beside that and joined to it, one row per group.
    """
    keys = [*by, split, level]
    df = df.where(not_null(*keys))
    values = [m for m in metrics if m.how == "nunique"]
    first_keys = [*keys, *dict.fromkeys(m.column for m in values)]
    states, held = {}, {}
    for j, m in enumerate(metrics):
        if m.how in QUANTILES:
            held.setdefault(m.column, {})[f"q{j}"] = QUANTILES[m.how]
        else:
            states.update(_states(m, j, is_whole(df, m.column)))
    states = states or {"c": (F.count(F.lit(1)), F.sum("c"))}
    begin = [start.alias(name) for name, (start, _) in states.items() if start is not None]
    if as_of is None and len({m.column for m in values}) == 1:
        # Each counted value has one row in its group: they need not be made distinct again.
        states.update({f"d{j}": (None, F.count(m.column)) for j, m in enumerate(metrics) if m.how == "nunique"})
    merge = [again.alias(name) for name, (_, again) in states.items()]
    bands: list[str] = []
    if as_of is not None:
        lookbacks = lookbacks or LOOKBACK_DAYS
        df = within_longest(df, as_of, lookbacks, time_col)
        df = df.withColumn("band", band(as_of, lookbacks, time_col))
        bands = ["band"]

    def per_lookback(partial: DataFrame) -> DataFrame:
        if not bands:
            return partial
        return partial.withColumn("lookback", F.explode(lookbacks_of("band", lookbacks)))

    partial = per_lookback(df.groupBy(*first_keys, *bands).agg(*begin))
    counted = {}
    for column in held:
        known = df.where(F.col(column).isNotNull()).groupBy(*keys, *bands, F.col(column).alias("_v"))
        counted[column] = per_lookback(known.agg(F.count(F.lit(1)).alias("_n")))
    keys = ["lookback", *keys] if bands else keys
    merged = partial.groupBy(*keys).agg(*merge)
    for column, wanted in held.items():
        values = counted[column].groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
        merged = merged.join(counted_quantiles(values, keys, wanted), keys, "left")
    return merged.select(*keys, *[_value(m, j).alias(m.name) for j, m in enumerate(metrics)])


def write_site_states(
    df: DataFrame,
    path: str,
    batch: str,
    metrics: list[Metric] = REPORT_METRICS,
    *,
    by: tuple[str, ...] = ("ds_scope",),
    split: str = SPLIT,
    level: str = LEVEL,
    time_col: str = "task_modificationtime",
) -> None:
    """The states of a batch of records, from which :func:`site_metrics_from_states` reports.

    A row for each day, group and combination of counted values, with the metrics' sums, counts
    and extremes. Quantiles have no such states.
    """
    keys = [*by, split, level]
    values = dict.fromkeys(m.column for m in metrics if m.how == "nunique")
    states = [
        start.alias(name)
        for j, m in enumerate(metrics)
        for name, (start, _) in _states(m, j, is_whole(df, m.column)).items()
        if start is not None
    ]
    rows = with_day(df.where(not_null(*keys)), time_col).groupBy(*keys, *values, DAY, INSTANT)
    write_states(rows.agg(*(states or [F.count(F.lit(1)).alias("c")])), path, batch)


def site_metrics_from_states(
    spark: SparkSession,
    path: str,
    metrics: list[Metric] = REPORT_METRICS,
    *,
    as_of: str,
    by: tuple[str, ...] = ("ds_scope",),
    split: str = SPLIT,
    level: str = LEVEL,
    lookbacks: dict[str, int] | None = None,
) -> DataFrame:
    """:func:`site_metrics` with look-backs of all batches written, without their records."""
    lookbacks = lookbacks or LOOKBACK_DAYS
    keys = ["lookback", *by, split, level]
    rows = read_states(spark, path, as_of, lookbacks)
    rows = rows.withColumn("lookback", F.explode(lookbacks_of("band", lookbacks)))
    merge = [again.alias(n) for j, m in enumerate(metrics) for n, (_, again) in _states(m, j, True).items()]
    merged = rows.groupBy(*keys).agg(*(merge or [F.sum("c").alias("c")]))
    return merged.select(*keys, *[_value(m, j).alias(m.name) for j, m in enumerate(metrics)])


# --- long reports -----------------------------------------------------------


def to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``(keys.., metric, value)``; a missing value has no row."""
    long = df.unpivot(keys, [F.col(f"`{n}`") for n in names], "metric", "value")
    return long.where(F.col("value").isNotNull())


def site_report(values: DataFrame, metrics: list[Metric] = REPORT_METRICS) -> DataFrame:
    """Site values, to one decimal."""
    names = [m.name for m in metrics]
    keys = [c for c in values.columns if c not in names]
    return to_long(values, keys, names).withColumn("value", round_even_1("value"))


def cloud_report(
    values: DataFrame, metrics: list[Metric] = REPORT_METRICS, level: str = LEVEL
) -> DataFrame:
    """Cloud values from the unrounded site values, to one decimal.

    A mean here is the unweighted mean of sites, and a cloud's users are the most
    of any one site.
    """
    names = [m.name for m in metrics]
    keys = [c for c in values.columns if c not in names and c != level]
    merge = [aggregate(m.across_sites, F.col(f"`{m.name}`")).alias(m.name) for m in metrics]
    merged = values.groupBy(*keys).agg(*merge)
    return to_long(merged, keys, names).withColumn("value", round_even_1("value"))


def pivot_wide(
    long: DataFrame,
    rows: list[str],
    columns: str,
    values: list[str] | None = None,
    value: str = "value",
) -> DataFrame:
    """Printed layout: one column per value of ``columns``; each cell must be unique.

    Without ``values`` Spark takes them from the data, which is a job of its own. A value
    that is not listed, or a cell that holds two values, is an error.
    """
    name = F.col(columns)
    if values is not None:
        missing = F.concat(F.lit("not among the listed columns: "), F.coalesce(name, F.lit("NULL")))
        long = long.withColumn(columns, F.when(name.isin(values), name).otherwise(F.raise_error(missing)))
    cell = F.when(F.count(value) <= 1, F.max(value)).otherwise(
        F.raise_error(F.lit("a cell holds more than one value")).cast("double")
    )
    return long.groupBy(*rows).pivot(columns, values).agg(cell)


def repeated_cells(long: DataFrame, rows: list[str], columns: str) -> DataFrame:
    """Cells that hold more than one value: empty when a strict pivot is possible."""
    return long.groupBy(*rows, columns).count().where("count > 1")


# --- one metric, three tables -------------------------------------------------


def metric_pivot(
    df: DataFrame,
    target: str,
    how: str,
    *,
    by: str = "ds_scope",
    split: str | None = SPLIT,
    level: str = LEVEL,
    weight: str = "number_of_jobs",
    limit: int | None = None,
) -> DataFrame:
    """One metric by (by, site) within each cloud, over all clouds, and by (by, cloud).

    With ``limit`` each table keeps its first row keys. ``part`` names the table. Without
    ``split`` there is one table, by (by, site), and it is whole.
    """
    keys = [by, level] if split is None else [by, split, level]
    df = df.where(not_null(*keys))
    if how in QUANTILES:
        # A site whose every value is missing has no row: its cell is empty anyway.
        sites = quantiles(df, keys, target, {"value": QUANTILES[how]})
    else:
        value = aggregate(how, target, weight, integral=is_whole(df, target)).cast("double")
        sites = df.groupBy(*keys).agg(value.alias("value"))
    if split is None:
        return sites
    clouds = sites.groupBy(by, split).agg(F.avg("value").alias("value"))
    in_cloud = all_sites = sites
    if limit is not None:
        first_keys = sites.select(by).distinct().orderBy(by).limit(limit)
        first_in_cloud = first_of_each(
            sites.select(split, by).distinct(), [split], F.asc(by), by, limit
        )
        in_cloud = sites.join(first_in_cloud, [split, by], "left_semi")
        all_sites = sites.join(first_keys, by, "left_semi")
        clouds = clouds.join(first_keys, by, "left_semi")
    no_level = F.lit(None).cast("string").alias(level)
    parts = {
        "within_cloud": in_cloud,
        "all_sites": all_sites,
        "by_cloud": clouds.withColumn(level, no_level),
    }
    layout = [by, split, level, "value"]
    return reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(part).alias("part"), *layout) for part, rows in parts.items()],
    )
