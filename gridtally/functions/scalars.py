"""Scalar expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit divisors.
MINUTE = 60
TIB = 1099511627776
TB = 1000000000000
GB = 1000000000
DAY_SECONDS = 86400
# Fixed value: how times are written.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(x: Column | str, y: Column | str | int | float) -> Column:
    """``x / y`` as double; NULL where y is 0 or missing."""
    y = F.lit(y) if isinstance(y, (int, float)) else _col(y)
    y = y.cast("double")
    return _col(x).cast("double") / F.nullif(y, F.lit(0.0))


def whole_div(x: Column, y: Column | int) -> Column:
    """Integer division of two bigint expressions."""
    return F.call_function("div", x, y if isinstance(y, Column) else F.lit(y))


def seconds(ts: Column | str) -> Column:
    """Epoch seconds of a zoneless timestamp; the session time zone plays no part."""
    return F.unix_timestamp(_col(ts))


def parse_time(text: Column | str) -> Column:
    """Timestamp of a date-time text."""
    return F.to_timestamp_ntz(_col(text), F.lit(TIME_FORMAT))


def plus_seconds(ts: Column | str, n: Column) -> Column:
    return F.timestamp_add("SECOND", n, _col(ts))


def round_even(x: Column | str) -> Column:
    return F.rint(_col(x))


def round_even_1(x: Column | str) -> Column:
    return F.rint(_col(x) * 10) / 10


def round_to_base(x: Column | str, base: int = 5) -> Column:
    """Nearest multiple of ``base``, halves to the even multiple."""
    return (F.lit(base) * F.rint(_col(x) / F.lit(float(base)))).cast("bigint")


def fraction(part: Column | str, whole: Column | str, scale: float = 1) -> Column:
    """``part / whole``, times ``scale``."""
    f = div(part, whole)
    return f if scale == 1 else f * F.lit(float(scale))


def strip_digits(c: Column | str) -> Column:
    return F.translate(_col(c), "0123456789", "")


def queue_seconds(created: Column | str, started: Column | str) -> Column:
    """Seconds from start to creation, wrapped into one day."""
    return F.pmod(seconds(created) - seconds(started), F.lit(DAY_SECONDS))


def queue_time(created: Column | str, started: Column | str) -> Column:
    """The same in minutes."""
    return queue_seconds(created, started) / F.lit(float(MINUTE))


def site_is_replica(site: Column | str, sites: Column | str) -> Column:
    """Is the site one of the comma-listed replica sites?"""
    return F.array_contains(F.split(_col(sites), ","), _col(site))


def cap_then_floor(optimum: Column, accesses: Column) -> Column:
    """Never more replicas than accesses; then at least one."""
    capped = F.when(optimum > accesses, accesses.cast("double")).otherwise(optimum)
    return F.when(capped == 0, F.lit(1.0)).otherwise(capped)


def audience_weight(users: Column) -> Column:
    """Logistic weight of the number of users."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(5.0) - users))


def verdict(next_accesses: Column, accesses: Column, decision: Column) -> Column:
    """Did use grow where more replicas were advised? Unknown counts as no."""
    return F.coalesce(((next_accesses - accesses) > 0) & (decision > 0), F.lit(False))


def percent(part: Column, total: Column) -> Column:
    return round_even_1(div(part, total) * 100)


def nan_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(float("nan")))


def round_9(x: Column | str) -> Column:
    """Nine decimals: enough to make sums independent of their order."""
    return F.round(_col(x), 9)
