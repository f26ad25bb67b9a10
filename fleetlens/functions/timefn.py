"""Time helpers; the session time zone is pinned to UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def utc_day(ts: Column) -> Column:
    """``YYYY-MM-DD`` of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd")


def utc_day_of_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)
