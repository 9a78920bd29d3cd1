"""Zone-less timestamps, handled without regard to the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_time(ts: Column, unit: str) -> Column:
    """Start of the hour, day or week."""
    day = F.to_date(ts)
    if unit == "week":
        return F.trunc(day, "week").cast("timestamp_ntz")
    midnight = day.cast("timestamp_ntz")
    return midnight if unit == "day" else midnight + F.make_dt_interval(hours=F.hour(ts))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, reading the value as UTC."""
    since = (ts - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("long")


def to_instant(ts: Column) -> Column:
    """The instant at which UTC clocks show ``ts``; what watermarks and windows need."""
    return F.timestamp_micros(micros(ts))


def from_instant(instant: Column) -> Column:
    """What UTC clocks show at an instant."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
