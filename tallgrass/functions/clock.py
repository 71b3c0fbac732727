"""Event time and the calendar, in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far an event's own time may lie before and after its arrival, in milliseconds: fixed values.
OLDEST_MS, NEWEST_MS = 86_400_000, 300_000


def trusted_time(event_ms: Column, arrival_ms: Column) -> Column:
    """The event's own time inside the band around its arrival, else the arrival."""
    return F.when(in_band(event_ms, arrival_ms), event_ms).otherwise(arrival_ms)


def in_band(event_ms: Column, arrival_ms: Column) -> Column:
    return F.coalesce(event_ms.between(arrival_ms - OLDEST_MS, arrival_ms + NEWEST_MS), F.lit(False))


def weekday(ts: Column) -> Column:
    return F.lower(F.date_format(ts, "EEEE"))


def is_business_hour(ts: Column) -> Column:
    """Monday to Friday, from 9 to before 17."""
    return (F.weekday(ts) < 5) & F.hour(ts).between(9, 16)
