"""Cutting the time axis: equal intervals, recency weights, latest values.

Times are handled as epoch seconds. A record's interval comes from integer
arithmetic in closed form, so no range join and no per-interval scan is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import plus_seconds, seconds, whole_div

WEIGHT_SCHEMES = ("newest_one", "newest_half", "linear", "exponential")

_CODE_BITS = 24
_CODE_MASK = (1 << _CODE_BITS) - 1
_CODE_SHIFT = 1 << (_CODE_BITS - 2)  # values lie within plus or minus this


def time_bounds(df: DataFrame, time_col: str) -> Column:
    """First and last second of the table as a scalar subquery ``struct(lo, hi)``.

    One row, computed once, in its own pass over a single column.
    """
    return df.agg(_bounds(time_col)).scalar()


def group_bounds(df: DataFrame, time_col: str, keys: list[str]) -> DataFrame:
    """The same per group: one small row per key."""
    return df.where(F.col(time_col).isNotNull()).groupBy(*keys).agg(_bounds(time_col))


def _bounds(time_col: str) -> Column:
    s = seconds(time_col)
    return F.struct(
        F.min(s).alias("lo"), F.max(s).alias("hi"), F.min(time_col).alias("start")
    ).alias("bounds")


def interval_index(
    df: DataFrame, time_col: str, bounds: Column, n: int
) -> tuple[Column, DataFrame]:
    """Index 0..n-1 of the half-open interval holding the time, else NULL.

    Interval starts are cut to whole seconds, so interval k begins at second
    ``floor(k * span / n)``; the last record lies in no interval. The offset and
    the span become columns first, so that a scalar subquery behind ``bounds`` is
    named a few times only.
    """
    df = df.withColumns(
        {"_offset": seconds(time_col) - bounds["lo"], "_span": bounds["hi"] - bounds["lo"]}
    )
    return index_of(F.col("_offset"), F.col("_span"), n), df


def index_of(offset: Column, span: Column, n: int) -> Column:
    """The same from seconds since the start of the span."""
    inside = (offset >= 0) & (offset < span)
    return F.when(inside, whole_div((offset + 1) * n - 1, span)).cast("int")


def interval_start(k: Column | int, bounds: Column, n: int) -> Column:
    """Start of interval k as a timestamp; ``k = n`` gives the end of the last one."""
    k = k if isinstance(k, Column) else F.lit(k)
    span = bounds["hi"] - bounds["lo"]
    return plus_seconds(bounds["start"], whole_div(k * span, n))


def recency_weight(k: int, n: int, scheme: str = "newest_one") -> Column:
    """Weight of interval k of n. The halving schemes are exact in double."""
    if scheme == "newest_one":
        return F.lit(2.0 ** -(n - 1 - k))
    if scheme == "newest_half":
        return F.lit(2.0 ** -(n - k))
    if scheme == "linear":
        return F.lit(float(k + 1)) / F.lit(float(n + 1))
    if scheme == "exponential":
        return F.exp(-F.lit(float(k + 1)) / F.lit(float(n + 1)))
    raise ValueError(f"unknown weight scheme {scheme!r}; one of {WEIGHT_SCHEMES}")


def weighted_total(counts: list[Column], scheme: str = "newest_one") -> Column:
    """Sum of the counts, each times its interval's weight, in interval order."""
    n = len(counts)
    total = counts[0] * recency_weight(0, n, scheme)
    for k in range(1, n):
        total = total + counts[k] * recency_weight(k, n, scheme)
    return total


def latest_code(value: str, time_col: str, value_type: T.DataType) -> Column:
    """Time and small integer in one bigint, so that ``max`` finds the latest value.

    ``max`` of a bigint stays in a hash aggregate with map-side combine, which an
    ordering by ``struct(time, value)`` would not. Within one second the largest
    value wins and a missing one loses. Never NULL: a row without a time is oldest.
    Types wider than smallint are checked; a value beyond four million is an error.
    """
    if not isinstance(value_type, T.IntegralType):
        raise TypeError(f"{value} must be a whole number, not {value_type.simpleString()}")
    number = F.col(value).cast("bigint")
    if not isinstance(value_type, (T.ByteType, T.ShortType)):
        too_large = F.raise_error(F.concat(F.lit(f"{value} out of range: "), number.cast("string")))
        number = F.when(F.abs(number) < _CODE_SHIFT, number).when(
            number.isNotNull(), too_large.cast("bigint")
        )
    code = F.coalesce(number + F.lit(_CODE_SHIFT + 1), F.lit(0))
    packed = F.shiftleft(seconds(time_col), _CODE_BITS) + code
    return F.coalesce(packed, F.lit(-(1 << 62)))


def latest_value(code: Column) -> Column:
    """The value inside a ``latest_code`` maximum."""
    low = code.bitwiseAND(F.lit(_CODE_MASK))
    return F.when(low > 0, low - F.lit(_CODE_SHIFT + 1)).cast("int")
