"""Look-backs that end on one day, each inside the next longer one.

A record belongs to one band: the rank of the shortest look-back that includes
it. A look-back is the union of the bands up to its own, so reports aggregate per
band and add bands up, instead of copying records into every look-back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Report look-backs in days.
LOOKBACK_DAYS = {"last_week": 7, "last_month": 30, "last_2_months": 60}


def end_of(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def start_of(as_of: str, days: int) -> Column:
    return end_of(as_of) - F.make_dt_interval(F.lit(days))


def within_longest(
    df: DataFrame, as_of: str, lookbacks: dict[str, int], time_col: str
) -> DataFrame:
    """Records of the longest look-back; a plain range, so it reaches the scan."""
    first = start_of(as_of, max(lookbacks.values()))
    return df.where(F.col(time_col).between(first, end_of(as_of)))


def band(as_of: str, lookbacks: dict[str, int], time_col: str) -> Column:
    days = sorted(lookbacks.values())
    expr = F.lit(len(days) - 1)
    for rank in reversed(range(len(days) - 1)):
        expr = F.when(F.col(time_col) >= start_of(as_of, days[rank]), F.lit(rank)).otherwise(expr)
    return expr


def lookbacks_of(band_col: str, lookbacks: dict[str, int]) -> Column:
    """Names of the look-backs that include a band."""
    names = F.array(*[F.lit(k) for k, _ in sorted(lookbacks.items(), key=lambda kv: kv[1])])
    return F.slice(names, F.col(band_col) + 1, F.lit(len(lookbacks)))
