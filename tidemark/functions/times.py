"""Functions on timestamps; both kinds of timestamp give the same results in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def iso_weekday(t: Column | str) -> Column:
    """Monday is 1."""
    return F.weekday(_c(t)) + 1


def nearest_minute(t: Column | str) -> Column:
    """half a minute rounds up."""
    return F.date_trunc("minute", _c(t) + F.expr("INTERVAL 30 SECONDS")).cast("timestamp_ntz")


def nearest_hour(t: Column | str) -> Column:
    return F.date_trunc("hour", _c(t) + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")


def between(unit: str, a: Column | str, b: Column | str) -> Column:
    """whole units from a to b, towards zero."""
    return F.timestamp_diff(unit, _c(a), _c(b))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / 1e6


#: Overlapping parts of the day, hours from and to; the last passes midnight.
DAY_PARTS = {"morning": (5, 13), "noon": (12, 19), "evening": (18, 23), "night": (22, 6)}


def in_part(t: Column | str, part: str) -> Column:
    a, b = DAY_PARTS[part]
    hour = F.hour(_c(t))
    return (hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)


def hour_group(t: Column | str) -> Column:
    """F28."""
    return F.floor(F.hour(_c(t)) / 4).cast("int")


def is_weekend(t: Column | str) -> Column:
    return iso_weekday(t) > 5
