"""Log timestamps and window ids on the wall clock of the line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_MINUTES = (1, 5, 15, 30, 60)


def instant(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def wall_clock(text: Column) -> Column:
    """The line's own clock, read as if it were the session's zone (UTC)."""
    return F.try_to_timestamp(F.substr(text, F.lit(1), F.lit(20)), F.lit("dd/MMM/yyyy:HH:mm:ss"))


def offset(text: Column) -> Column:
    return F.regexp_extract(text, r"([+-]\d{4})$", 1)


def millisecond_instant(text: Column) -> Column:
    """Timestamps of load balancers: milliseconds, no zone."""
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss.SSS"))


def window_size(minutes: int) -> int:
    return minutes if minutes in WINDOW_MINUTES else 10


def window_id(wall: Column, minutes: int | Column) -> Column:
    """yyyyMMddHHmm of the window's start as a BIGINT; NULL timestamps have none. Sizes other than 1, 5, 15, 30 and 60 minutes count as 10."""
    size = window_size(minutes) if isinstance(minutes, int) else F.when(minutes.isin(*WINDOW_MINUTES), minutes).otherwise(10)
    start = F.floor(F.minute(wall) / size) * size
    return F.date_format(wall, "yyyyMMddHH").cast("bigint") * 100 + start.cast("bigint")
