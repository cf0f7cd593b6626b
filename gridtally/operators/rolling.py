"""Advice recomputed over sliding windows, and its outcome over all of them.

The windows are laid on the time axis by arithmetic: with ``o`` seconds since the
first record, ``o div step`` is the newest window that can hold a record, and it
reaches back ``length div step`` windows.

The bounds of all windows and of all their intervals cut time into segments, about two
per day. A task counts in an interval once, with its first visit there: the visit whose
predecessor (of that task at that dataset) lies before the interval. So the log is reduced
to distinct (dataset, task, segment), each row is told its predecessor, and visits are added
up by dataset, segment and the interval starts that their predecessor precedes. Those rows,
no more than the log has, are shuffled by dataset and only then copied into their windows.
Users are counted the same way. Nothing is cached; the log is read once for all of it.

Tables of the calendar (windows, segments) have a few rows per step of time and follow the
time span only, never the number of records; they are broadcast.

Rows are sparse: a dataset has one for each window that holds a record of it. What
the absent ones would say (no use, one replica) needs no rows, see
``advice_outcome``. Window bounds come from all records, those without a name included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import index_of, latest_code, latest_value, weighted_total
from ..functions.scalars import (
    DAY_SECONDS,
    GB,
    audience_weight,
    cap_then_floor,
    div,
    plus_seconds,
    round_9,
    round_even,
    seconds,
    whole_div,
)
from .frequency import DATASET


class _Axis:
    """Window k covers ``[k * step, k * step + length)`` seconds after the first record."""

    def __init__(self, length_days: int, step_days: int):
        self.step = step_days * DAY_SECONDS
        self.back, self.tail = divmod(length_days * DAY_SECONDS, self.step)

    def windows_of(self, block: Column, in_tail: Column) -> Column:
        """Every window holding a record of that block of time, as an array."""
        reach = F.when(in_tail, F.lit(self.back)).otherwise(F.lit(self.back - 1))
        oldest = F.greatest(block - reach, F.lit(0).cast("bigint"))
        return F.when(oldest <= block, F.sequence(oldest, block))

    def block(self, offset: Column) -> Column:
        return whole_div(offset, self.step)

    def in_tail(self, offset: Column) -> Column:
        return offset % self.step < self.tail


def window_bounds(times: DataFrame, axis: _Axis) -> DataFrame:
    """First and last record of every non-empty window that starts before the last record.

    ``times`` has the second ``s`` of each record. One row per step of the covered time
    span: its size follows the calendar, never the number of records.
    """
    span = times.agg(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi"))).scalar()
    offset = times.where(F.col("s").isNotNull()).select((F.col("s") - span["lo"]).alias("o"))
    blocks = offset.groupBy(
        axis.block(F.col("o")).alias("block"), axis.in_tail(F.col("o")).alias("in_tail")
    ).agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    spread = blocks.select(
        F.explode(axis.windows_of(F.col("block"), F.col("in_tail"))).alias("k"), "lo", "hi"
    )
    return (
        spread.groupBy("k")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("first", span["lo"])
        .where(F.col("k") * axis.step < span["hi"] - span["lo"])
    )


def segments(windows: DataFrame, axis: _Axis, n: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of time that no window and no interval cuts, and where each belongs.

    First (block, start, end), in seconds since the first record; every record of a block lies
    in one of them. Then (start, k, i, since): the windows that hold the segment, its interval
    there (NULL for the end of a window) and where that interval begins.
    """
    lo, span = F.col("lo"), F.col("hi") - F.col("lo")
    # The first second of interval j, as index_of counts them; the window's last record is in none.
    begins = [lo, *[lo + whole_div(span * j + n, n) - 1 for j in range(1, n)], F.col("hi")]
    begins = [F.greatest(b, lo) for b in begins]
    edges = F.array(F.col("k") * axis.step, (F.col("k") + axis.back) * axis.step + axis.tail, *begins)
    # One row holds them all, about ten for each window. Every block has a start of its own, so
    # that a segment never spans two of them.
    every = F.flatten(F.collect_list(edges))
    reach = F.sequence(F.array_min("e"), F.array_max("e"), F.lit(axis.step).cast("bigint"))
    starts = windows.agg(every.alias("e")).where(F.size("e") > 0).select(F.explode(F.array_union("e", reach)).alias("start"))
    starts = starts.withColumn("block", axis.block(F.col("start")))
    following = Window.partitionBy("block").orderBy("start")
    ends = F.coalesce(F.lead("start").over(following), (F.col("block") + 1) * axis.step)
    cells = starts.withColumn("end", ends)
    holding = F.explode(axis.windows_of(F.col("block"), axis.in_tail(F.col("start"))))
    interval = index_of(F.col("start") - lo, span, n)
    since = F.get(F.array(*begins), F.coalesce(interval, F.lit(n)))
    places = (
        cells.select("start", holding.alias("k"))
        .join(windows, "k")
        .select("start", "k", interval.alias("i"), since.alias("since"))
    )
    return cells, places


def shared(rows: DataFrame, by: str | None = None) -> DataFrame:
    """The rows after one shuffle that all their readers share.

    Packed, a row is one column that no reader narrows or filters before the shuffle. It goes by
    ``by``, which must not be missing, or else by all of its values.
    """
    packed = F.array(F.struct(*[c for c in rows.columns if c != by])).alias("r")
    if by is None:
        return rows.select(packed).repartition("r").select(F.inline("r"))
    return rows.select(by, packed).repartition(by).select(by, F.inline("r"))


def first_visits(placed: DataFrame, who: str, sinces: DataFrame, name: str, most: int, extra: list[Column]) -> DataFrame:
    """(dataset, start, ``name``_r, ...): visits of ``who`` in a segment, told apart by their predecessor.

    r is how many of the ``sinces`` of the segment, at most ``most`` in ascending order, are not
    after the predecessor: the visit is a first one in the intervals that begin later. The
    visits with all of them before it are first nowhere and not counted.
    """
    rows = placed.groupBy(DATASET, who, "start").agg(*extra) if extra else placed.select(DATASET, who, "start").distinct()
    before = F.lag("start").over(Window.partitionBy(DATASET, who).orderBy("start"))
    rank = F.size(F.filter("sinces", lambda since: since <= F.col("before")))
    ranked = rows.withColumn("before", before).join(F.broadcast(sinces), "start").withColumn("rank", rank)
    counts = [F.count(F.when(F.col("rank") == r, F.col(who))).alias(f"{name}_{r}") for r in range(most)]
    return ranked.groupBy(DATASET, "start").agg(*counts, *[F.max(c).alias(c) for c in ranked.columns if c == "code"])


def visits_per_segment(records: DataFrame, windows: DataFrame, axis: _Axis, n: int) -> tuple[DataFrame, DataFrame]:
    """Distinct tasks ``t_r`` and users ``v_r`` by (dataset, segment), see ``first_visits``, and the places.

    A visit of a task or user that many visits follow in the same interval is one row. What is
    shuffled last is a row for each (dataset, segment), so a task holds for one dataset as many
    rows as there are segments.
    """
    first = records.agg(F.min("s")).scalar()
    cells, places = segments(windows, axis, n)
    known = records.where(F.col("s").isNotNull() & F.col(DATASET).isNotNull())
    offset = known.withColumn("o", F.col("s") - first)
    cell = F.broadcast(cells.withColumnRenamed("block", "_block"))
    inside = (axis.block(F.col("o")) == F.col("_block")) & (F.col("o") >= F.col("start")) & (F.col("o") < F.col("end"))
    placed = offset.join(cell, inside)
    held = F.collect_list(F.struct("k", "i", "since")).alias("held")
    sinces = places.groupBy("start").agg(F.sort_array(F.collect_set("since")).alias("sinces"), held)
    places = sinces.select("start", "sinces", F.inline("held")).select(
        "start", "k", "i", F.array_position("sinces", F.col("since")).alias("turn")
    )
    sinces = sinces.select("start", "sinces")
    most = axis.back + 1
    by_task = first_visits(placed, "jeditaskid", sinces, "t", most, [F.max("code").alias("code")])
    by_user = first_visits(placed, "username", sinces, "v", most, [])
    # Every row of either side has one on the other: both come from the same records.
    return shared(by_task.join(by_user, [DATASET, "start"]), DATASET), places


def use_per_window(visits: DataFrame, places: DataFrame, axis: _Axis, n: int, also: list[str]) -> DataFrame:
    """Distinct tasks ``n_j`` and users ``u_j`` in each interval j of each window, and what ``also`` names.

    Visits lie by dataset, so that their copies in the windows are added up without another shuffle.
    """

    def first_ones(name: str) -> Column:
        return sum((F.when(F.col("turn") > r, F.col(f"{name}_{r}")).otherwise(0) for r in range(axis.back + 1)), F.lit(0))

    # Tasks and users of an interval, fewer than 2^31 of either, are added up in one bigint: a
    # task's hash table has a row for each window and dataset.
    both = F.shiftleft(first_ones("v").cast("bigint"), 31) + first_ones("t")
    placed = visits.join(F.broadcast(places), "start").select("k", DATASET, "i", both.alias("both"), "code", *also)
    sums = [F.sum(F.when(F.col("i") == j, F.col("both")).otherwise(0)).alias(f"b_{j}") for j in range(n)]
    summed = placed.groupBy("k", DATASET).agg(*sums, *[F.max(c).alias(c) for c in ("code", *also)])
    tasks = [F.col(f"b_{j}").bitwiseAND(F.lit((1 << 31) - 1)).alias(f"n_{j}") for j in range(n)]
    users = [F.shiftright(f"b_{j}", 31).alias(f"u_{j}") for j in range(n)]
    return summed.select("k", DATASET, *tasks, *users, "code", *also)


def _use(df: DataFrame, axis: _Axis, n: int, scheme: str, time_col: str) -> tuple[DataFrame, DataFrame]:
    """Use and size per (window, dataset), and the calendar with each window's group average."""
    code = latest_code("ds_replicas_number", time_col, df.schema["ds_replicas_number"].dataType)
    records = shared(
        df.select(DATASET, "jeditaskid", "username", seconds(time_col).alias("s"), code.alias("code"), "ds_bytes")
    )
    windows = window_bounds(records.select("s"), axis)
    weighted = [F.col(f"n_{j}") * audience_weight(F.col(f"u_{j}")) for j in range(n)]
    visits, places = visits_per_segment(records, windows, axis, n)

    def use_of(visits: DataFrame, *also: str) -> DataFrame:
        return use_per_window(visits, places, axis, n, list(also)).select(
            "k",
            DATASET,
            (weighted_total(weighted, scheme) / float(n)).alias("af"),
            F.col(f"n_{n - 1}").alias("accesses"),
            F.col(f"u_{n - 1}").alias("users"),
            "code",
            *also,
        )

    sizes = records.where(F.col(DATASET).isNotNull()).groupBy(DATASET).agg(div(F.max("ds_bytes"), GB).alias("ds_size_GB"))
    # The size is named so that both readers of the sizes share one shuffle.
    n_datasets = sizes.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("ds_size_GB"))).scalar()["n"]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    totals = use_of(visits).groupBy("k").agg(F.sum("af").alias("total"))
    calendar = windows.join(totals, "k", "left").select(
        "k",
        plus_seconds(epoch, F.col("first") + F.col("k") * axis.step).alias("window_start"),
        plus_seconds(epoch, F.col("first") + F.col("hi")).alias("timestamp"),
        div(F.coalesce("total", F.lit(0.0)), n_datasets).alias("groupAF"),
    )
    return use_of(visits.join(sizes, DATASET), "ds_size_GB"), calendar


def rolling_advice(
    df: DataFrame,
    *,
    n: int = 8,
    length_days: int = 60,
    step_days: int = 7,
    scheme: str = "newest_one",
    time_col: str = "task_modificationtime",
) -> DataFrame:
    """Advice for every dataset in every window that holds a record of it."""
    use, calendar = _use(df, _Axis(length_days, step_days), n, scheme, time_col)
    rows = use.join(F.broadcast(calendar), "k")
    optimum = round_even(round_9(div("af", "groupAF")))
    return rows.select(
        DATASET,
        F.col("af").alias("datasetAF"),
        "groupAF",
        latest_value(F.col("code")).alias("curr_n_replicas"),
        F.col("accesses").alias("curr_n_accesses"),
        F.col("users").alias("curr_n_users"),
        cap_then_floor(optimum, F.col("accesses")).alias("optimal_n_replicas"),
        "ds_size_GB",
        "timestamp",
        "window_start",
    )


def rolling_calendar(
    df: DataFrame,
    *,
    n: int = 8,
    length_days: int = 60,
    step_days: int = 7,
    scheme: str = "newest_one",
    time_col: str = "task_modificationtime",
) -> DataFrame:
    """timestamp, window_start and groupAF of every non-empty window: one row per step of time."""
    calendar = _use(df, _Axis(length_days, step_days), n, scheme, time_col)[1]
    return calendar.select("timestamp", "window_start", "groupAF")


def advice_outcome(weekly: DataFrame, calendar: DataFrame) -> DataFrame:
    """What the advice would have created per dataset over all windows of the calendar.

    Windows are ordered by ``timestamp``, then ``window_start``, newest first. In a window
    without a row a dataset has no use and advice of one replica (none at all where
    nothing was used), and the replicas of the next later row. So sums, extremes and
    the advice in the newest, second newest and oldest window are enough, and each is one
    aggregate over the rows there are.
    """
    key = F.struct("timestamp", "window_start")
    ordered = F.sort_array(F.collect_list(key), asc=False)
    facts = calendar.agg(
        F.struct(
            ordered.alias("w"),
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list(F.when(~(F.coalesce("groupAF", F.lit(0.0)) > 0), key))).alias("idle"),
        )
    ).scalar()
    rows = weekly.where(F.col(DATASET).isNotNull()).withColumn("_facts", facts).withColumn("_at", key)
    windows, idle, n = F.col("_facts.w"), F.col("_facts.idle"), F.col("_facts.n")
    places = {"newest": windows[0], "second": F.get(windows, F.lit(1)), "oldest": F.element_at(windows, -1)}

    def at(column: str, place: str) -> Column:
        return F.max(F.when(F.col("_at") == places[place], F.col(column))).alias(f"{column}_{place}")

    seen = [F.max(F.col("_at") == places[p]).alias(f"seen_{p}") for p in places]
    absent = [F.max(F.when(F.array_contains(idle, places[p]), None).otherwise(1.0)).alias(f"absent_{p}") for p in places]
    known = rows.withColumn("s", F.col("optimal_n_replicas")).withColumn("r", F.col("curr_n_replicas").cast("double"))
    summary = known.groupBy(DATASET).agg(
        *[at("s", p) for p in places],
        *seen,
        *absent,
        at("r", "newest"),
        F.max(n).alias("n"),
        F.max(F.size(idle)).alias("idle"),
        (F.count("s") == F.count(F.lit(1))).alias("known"),
        F.min("r").alias("_min_r"),
        F.max("r").alias("_max_r"),
        F.max("ds_size_GB").alias("ds_size_GB"),
        F.sum("curr_n_accesses").alias("total_n_accesses"),
        F.max("curr_n_users").alias("total_n_users"),
        F.sum("datasetAF").alias("af"),
    )

    def advice(place: str) -> Column:
        return F.when(F.col(f"seen_{place}"), F.col(f"s_{place}")).otherwise(F.col(f"absent_{place}"))

    # A missing advice anywhere makes the differences after the second window unknown.
    later = F.when(F.col("known") & (F.col("idle") == 0), advice("oldest") - advice("second"))
    created = advice("newest") - F.col("r_newest")
    created = created + F.when(F.col("n") >= 3, later).otherwise(F.lit(0.0))
    summary = summary.withColumn("_created", created)
    too_few = (F.col("_created") <= 0) | (F.col("_created") < F.col("_min_r"))
    return summary.select(
        DATASET,
        F.when(too_few, F.col("_min_r")).otherwise(F.col("_created")).alias("replicas_created_simul"),
        "ds_size_GB",
        "total_n_accesses",
        "total_n_users",
        F.col("_max_r").alias("replicas_created_real"),
        (F.col("af") / F.col("n")).alias("datasetAF"),
    ).select(
        "*",
        (F.col("ds_size_GB") * F.col("replicas_created_simul")).alias("simul_created_volume"),
        (F.col("ds_size_GB") * F.col("replicas_created_real")).alias("real_created_volume"),
    )


def backfill(column: str, newest_first) -> Column:
    """The value, or where it is missing the next later one."""
    frame = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(frame)
