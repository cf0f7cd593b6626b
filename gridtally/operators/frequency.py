"""Recency-weighted access frequency and the replica advice that follows from it.

Shape of every job here:

1. ``access_profile`` reduces the access log to one row per dataset (or per
   dataset and place): the distinct accesses in each of n time intervals, as n
   columns. Rows are first made distinct by (dataset, interval, task) with
   map-side combine, so a dataset holding a third of all records is spread over
   its tasks and never meets in one place.
2. Totals over all datasets are one-row scalar subqueries over the same profile;
   they share its shuffle (``ReusedExchange``).
3. Zeros of the intervals are restored from the profile's own columns, with no join
   of datasets with intervals. Places have rows where there was use; zeros are added
   for the places a caller lists.
4. Time bounds come from all records of the table, those without a name included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import (
    group_bounds,
    interval_index,
    interval_start,
    latest_code,
    latest_value,
    recency_weight,
    time_bounds,
    weighted_total,
)
from ..functions.predicates import not_null, quality
from ..functions.scalars import div, round_even

DATASET = "datasetname"
PLACE = "_place"
PLACE_COLUMNS = {"cloud": "site_cloud", "site": "site_name"}

# The pairs of the per-project advice.
PROJECTS = [
    "data16_13TeV",
    "mc16_13TeV",
    "data18_13TeV",
    "data15_13TeV",
    "mc15_13TeV",
    "data17_13TeV",
]
DATA_TYPES = ["DAOD", "AOD"]


def interval_columns(n: int) -> list[Column]:
    return [F.col(f"n_{k}") for k in range(n)]


def access_profile(
    df: DataFrame,
    bounds: Column,
    n: int,
    *,
    keys: list[str],
    time_col: str,
    count_col: str,
    value_col: str | None = None,
) -> DataFrame:
    """One row per key: distinct ``count_col`` per interval in ``n_0 .. n_{n-1}``.

    ``active`` tells whether any record lies inside an interval. With
    ``value_col``, ``last_code`` carries its value at the latest time.
    """
    index, df = interval_index(df, time_col, bounds, n)
    selected = [*keys, F.col(count_col).alias("_what"), index.alias("_i")]
    last = []
    if value_col:
        code = latest_code(value_col, time_col, df.schema[value_col].dataType)
        last = [F.max("last_code").alias("last_code")]
        rows = df.select(*selected, code.alias("last_code"))
        distinct = rows.groupBy(*keys, "_i", "_what").agg(*last)
    else:
        distinct = df.select(*selected).distinct()
    counts = [
        F.count(F.when(F.col("_i") == k, F.col("_what"))).alias(f"n_{k}") for k in range(n)
    ]
    active = (F.count("_i") > 0).alias("active")
    return distinct.groupBy(*keys).agg(*counts, active, *last)


def _weighted(profile: DataFrame, n: int, scheme: str) -> DataFrame:
    """Add ``weight``: the weighted accesses, n times the access frequency.

    Totals are taken over this column and divided once. With the halving schemes
    it is exact in double, so no total depends on the order of its rows.
    """
    return profile.withColumn("weight", weighted_total(interval_columns(n), scheme))


def _group_frequency(profile: DataFrame, n: int, n_datasets: str) -> Column:
    """Average frequency over all datasets, from a scalar subquery over the profile."""
    group = profile.agg(
        F.struct(F.sum("weight").alias("total"), F.count(n_datasets).alias("n"))
    ).scalar()
    return div(group["total"], group["n"] * n)


def _frequency(n: int) -> Column:
    return F.col("weight") / F.lit(float(n))


def interval_access(
    df: DataFrame,
    *,
    n: int = 10,
    scheme: str = "newest_half",
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
) -> DataFrame:
    """Accesses of every dataset in every interval, zeros included."""
    bounds = time_bounds(df, time_col)
    df = df.where(F.col(DATASET).isNotNull())
    profile = access_profile(
        df, bounds, n, keys=[DATASET], time_col=time_col, count_col=count_col
    )
    cells = F.array(
        *[
            F.struct(
                interval_start(k, F.col("_bounds"), n).alias("timestamp"),
                recency_weight(k, n, scheme).alias("weight"),
                count.alias("n_accesses"),
            )
            for k, count in enumerate(interval_columns(n))
        ]
    )
    return (
        profile.withColumn("_bounds", bounds)
        .select(DATASET, F.inline(cells))
        .withColumn("weighted_accesses", F.col("n_accesses") * F.col("weight"))
    )


def replication_advice(
    df: DataFrame,
    *,
    n: int = 8,
    scheme: str = "newest_one",
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
) -> DataFrame:
    """Optimal replica number per dataset against its latest known number."""
    profile = access_profile(
        df.where(F.col(DATASET).isNotNull()),
        time_bounds(df, time_col),
        n,
        keys=[DATASET],
        time_col=time_col,
        count_col=count_col,
        value_col="ds_replicas_number",
    )
    profile = _weighted(profile, n, scheme)
    # last_code is never NULL, so counting it counts the datasets; counting it and
    # not rows keeps this branch's aggregate, hence its shuffle, equal to the main one.
    return _advise(profile, _group_frequency(profile, n, "last_code"), n)


def _advise(profile: DataFrame, group_af: Column, n: int, *keys: str) -> DataFrame:
    frequencies = profile.withColumns({"datasetAF": _frequency(n), "groupAF": group_af})
    return frequencies.select(
        *keys,
        DATASET,
        "datasetAF",
        "groupAF",
        latest_value(F.col("last_code")).alias("curr_n_replicas"),
        round_even(div("datasetAF", "groupAF")).alias("optimal_n_replicas"),
        F.col(f"n_{n - 1}").alias("curr_n_accesses"),
    ).withColumn("decision", F.col("optimal_n_replicas") - F.col("curr_n_replicas"))


def advice_by_project(
    df: DataFrame,
    *,
    projects: list[str] = PROJECTS,
    data_types: list[str] = DATA_TYPES,
    n: int = 8,
    scheme: str = "newest_one",
    time_col: str = "attempt_start",
    count_col: str = "username",
) -> DataFrame:
    """Advice on distinct users, all (project, data type) pairs in one job.

    Each pair has its own time bounds and group average. Both are one row per
    pair, and the pairs come from the two lists, which bounds the broadcasts. A record
    without a time or a name counts towards the bounds at most.
    """
    keys = ["ds_scope", "ds_data_type"]
    df = df.where(quality(data_type=data_types, project=projects))
    bounds = group_bounds(df, time_col, keys)
    profile = access_profile(
        df.where(not_null(time_col, DATASET)).join(F.broadcast(bounds), keys),
        F.col("bounds"),
        n,
        keys=[*keys, DATASET],
        time_col=time_col,
        count_col=count_col,
        value_col="ds_replicas_number",
    )
    profile = _weighted(profile, n, scheme)
    group = profile.groupBy(*keys).agg(
        div(F.sum("weight"), F.count("last_code") * n).alias("_group_af")
    )
    advice = _advise(profile.join(F.broadcast(group), keys), F.col("_group_af"), n, *keys)
    return advice.drop("curr_n_accesses")


def frequency_for_list(
    df: DataFrame,
    datasets: DataFrame,
    *,
    n: int = 8,
    scheme: str = "newest_one",
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
) -> DataFrame:
    """Access frequency of the listed datasets in ``df``; an unseen one gets 0.

    Time bounds come from all records, the group average from the whole list. The
    list meets the profile, one row per dataset. Joining the records with it first
    would gather each dataset's records in one task.
    """
    listed = datasets.select(DATASET).where(F.col(DATASET).isNotNull()).distinct()
    profile = access_profile(
        df.where(F.col(DATASET).isNotNull()),
        time_bounds(df, time_col),
        n,
        keys=[DATASET],
        time_col=time_col,
        count_col=count_col,
    )
    profile = listed.join(_weighted(profile, n, scheme), DATASET, "left").select(
        DATASET, F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
    return profile.select(
        DATASET,
        _frequency(n).alias("new_datasetAF"),
        _group_frequency(profile, n, "weight").alias("new_groupAF"),
    )


def profile_with_latest_mean(
    df: DataFrame, bounds: Column, n: int, *, value_col: str, time_col: str, count_col: str
) -> DataFrame:
    """The profile of each dataset, and ``_mean``: the value's mean over all rows at its latest time.

    A record counts as an access of its interval and as a value at its time. Both are reduced
    in one shuffle, by (dataset, interval, what) and (dataset, time), and put together per
    dataset in the next. No ranking window, so a hot dataset is not sorted in one task.
    """
    index, df = interval_index(df, time_col, bounds, n)
    kinds = {c: dict(df.dtypes)[c] for c in (count_col, time_col, value_col)}
    none = {c: F.lit(None).cast(kind) for c, kind in kinds.items()}
    no_value = none[value_col].alias("_value")
    access = F.struct(index.alias("_i"), F.col(count_col).alias("_what"), none[time_col].alias("_t"), no_value)
    latest = F.struct(
        F.lit(None).cast("int").alias("_i"), none[count_col].alias("_what"), F.col(time_col).alias("_t"),
        F.col(value_col).alias("_value"),
    )
    reduced = (
        df.select(DATASET, F.inline(F.array(access, latest)))
        .groupBy(DATASET, "_i", "_what", "_t")
        .agg(F.sum("_value").alias("_sum"), F.count("_value").alias("_n"))
    )
    counts = [F.count(F.when(F.col("_i") == k, F.col("_what"))).alias(f"n_{k}") for k in range(n)]
    mean = div(F.max_by("_sum", "_t"), F.max_by("_n", "_t")).alias("_mean")
    return reduced.groupBy(DATASET).agg(*counts, mean)


def dataset_frequency(
    df: DataFrame,
    *,
    n: int = 10,
    scheme: str = "newest_half",
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
) -> DataFrame:
    """Frequency, group frequency and optimal replicas, one row per dataset."""
    profile = profile_with_latest_mean(
        df.where(F.col(DATASET).isNotNull()),
        time_bounds(df, time_col),
        n,
        value_col="ds_replicas_number",
        time_col=time_col,
        count_col=count_col,
    )
    return frequency_of(profile, n, scheme)


def frequency_of(profile: DataFrame, n: int, scheme: str) -> DataFrame:
    """:func:`dataset_frequency` from the profile with the latest mean."""
    profile = _weighted(profile, n, scheme)
    # The mean is named so that the total and the result share both shuffles.
    group = profile.agg(
        F.struct(F.sum("weight").alias("total"), F.count("weight").alias("n"), F.max("_mean").alias("mean"))
    ).scalar()
    profile = profile.withColumns({"_af": _frequency(n), "_group": div(group["total"], group["n"] * n)})
    return profile.select(
        DATASET,
        F.col("_mean").alias("current_n_replicas"),
        F.col(f"n_{n - 1}").alias("current_accesses"),
        F.col("_af").alias("ds_avg_access_frequency"),
        F.col("_group").alias("group_avg_access_frequency"),
        round_even(div("_af", "_group")).alias("optimal_replicas_number"),
    )


def place_use(
    df: DataFrame,
    place_col: str,
    places: list[str] | None,
    *,
    n: int,
    scheme: str,
    time_col: str,
    count_col: str,
) -> DataFrame:
    """datasetname, _place, its weighted use _use and the dataset's _total.

    One row per place with use, and for listed ``places`` one of zero where a used
    dataset had none there. Records without a place count towards which datasets were
    used, never towards use.
    """
    profile = access_profile(
        df.where(F.col(DATASET).isNotNull()),
        time_bounds(df, time_col),
        n,
        keys=[DATASET, place_col],
        time_col=time_col,
        count_col=count_col,
    )
    return use_of(profile.withColumnRenamed(place_col, PLACE), places, n, scheme)


def use_of(profile: DataFrame, places: list[str] | None, n: int, scheme: str) -> DataFrame:
    """:func:`place_use` from the profile of (dataset, ``_place``)."""
    profile = _weighted(profile, n, scheme)
    if places is not None:
        used = profile.groupBy(DATASET).agg(F.bool_or("active").alias("active")).where("active")
        listed = F.explode(F.array(*[F.lit(p) for p in places]).cast("array<string>"))
        zeros = used.select(DATASET, listed.alias("_place"), F.lit(0.0).alias("weight"))
        used_places = profile.select(DATASET, "_place", "weight").where(F.col("weight") > 0)
        profile = used_places.unionByName(zeros).groupBy(DATASET, "_place").agg(
            F.max("weight").alias("weight")
        )
    else:
        profile = profile.where(F.col("weight") > 0)
    rows = profile.where(F.col("_place").isNotNull())
    # As many rows as a dataset has places meet here.
    total = F.sum("weight").over(Window.partitionBy(DATASET)).alias("_total")
    return rows.select(DATASET, "_place", F.col("weight").alias("_use"), total)


def place_shares(
    df: DataFrame,
    place: str,
    *,
    n: int = 10,
    scheme: str = "newest_half",
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
    places: list[str] | None = None,
) -> DataFrame:
    """Share of every used place in a dataset's use, and the replicas due there.

    ``place`` is ``'cloud'`` or ``'site'``. Listed ``places`` have rows of zero as well.
    """
    options = {"n": n, "scheme": scheme, "time_col": time_col, "count_col": count_col}
    by_place = place_use(df, PLACE_COLUMNS[place], places, **options)
    return shares_of(dataset_frequency(df, **options), by_place, place, n)


def shares_of(frequency: DataFrame, use: DataFrame, place: str, n: int) -> DataFrame:
    """:func:`place_shares` from both of its sides."""
    rows = frequency.join(use, DATASET)
    share, due = f"x_{place}s", f"n_replicas_at_{place}"
    return (
        rows.withColumn(share, div("_use", "_total"))
        .withColumn(due, round_even(F.col("optimal_replicas_number") * F.col(share)))
        .select(
            F.col("_place").alias(place),
            (F.col("_use") / F.lit(float(n))).alias("weighted_accesses"),
            DATASET,
            share,
            "current_n_replicas",
            "current_accesses",
            "ds_avg_access_frequency",
            "group_avg_access_frequency",
            "optimal_replicas_number",
            due,
        )
    )


def placement(
    df: DataFrame,
    prior_advice: DataFrame,
    place: str,
    *,
    n: int = 10,
    scheme: str = "newest_one",
    time_col: str = "attempt_start",
    count_col: str = "jeditaskid",
    places: list[str] | None = None,
) -> DataFrame:
    """Spread the replicas of earlier advice over the clouds or sites in use.

    Datasets without a record inside an interval are left out. Listed ``places`` have
    rows of zero as well.
    """
    options = {"n": n, "scheme": scheme, "time_col": time_col, "count_col": count_col}
    return placement_of(place_use(df, PLACE_COLUMNS[place], places, **options), prior_advice, place, n)


def placement_of(use: DataFrame, prior_advice: DataFrame, place: str, n: int) -> DataFrame:
    """:func:`placement` from the use of places."""
    rows = use.join(prior_advice, DATASET, "left")
    due = round_even(F.col("optimal_n_replicas") * div("_use", "_total"))
    return rows.select(
        DATASET,
        (F.col("_total") / F.lit(float(n))).alias(f"datasetAF_all_{place}s"),
        F.col("_place").alias(place),
        (F.col("_use") / F.lit(float(n))).alias(f"datasetAF_{place}"),
        *[c for c in prior_advice.columns if c != DATASET],
        due.alias(f"replicas_at_{place}"),
    )
