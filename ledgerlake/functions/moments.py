"""Zone-free times (``timestamp_ntz``) as microseconds and as UTC instants, for any session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(moment: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), moment)


def moment_of(number: Column) -> Column:
    """The zone-free time that is ``number`` microseconds after 1970."""
    return F.timestamp_add("MICROSECOND", number, _epoch())


def utc_instant(moment: Column) -> Column:
    """The instant at which a UTC clock shows ``moment``; watermarks need such a zoned time."""
    return F.timestamp_micros(micros(moment))


def clock_time(instant: Column) -> Column:
    """What a UTC clock shows at ``instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())
