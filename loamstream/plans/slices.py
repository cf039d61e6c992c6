"""Time slices: the unit by which a long or hot series is spread over tasks.

A logger's whole history must never sit in one task. Ordered work is done inside (key, slice) and
only one summary row per (key, slice) travels between slices; the number of slices is bounded by
the time span, not by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone is UTC)."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def slice_of(ts: Column | str, width: float) -> Column:
    """Number of the slice of `width` seconds that holds `ts`."""
    return F.floor(micros(ts) / F.lit(width * 1_000_000)).cast("bigint")


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(6e7)


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def shift(ts: Column | str, seconds: Column | float) -> Column:
    """`ts` moved by a number of seconds, type kept as TIMESTAMP_NTZ."""
    step = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_micros(
        (micros(ts) + F.round(step * F.lit(1e6)).cast("bigint"))
    ).cast("timestamp_ntz")


def floor_to(ts: Column | str, width: int) -> Column:
    """Start of the bin of `width` seconds that holds `ts`, bins aligned to 1970-01-01."""
    return F.timestamp_micros(slice_of(ts, width) * F.lit(width * 1_000_000)).cast("timestamp_ntz")
