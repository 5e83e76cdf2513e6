"""Time buckets of any fixed width, aligned to 2000-01-03 as time-series stores do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = "2000-01-03 00:00:00"


def time_bucket(ts: Column, width_us: int) -> Column:
    """Start of the bucket of ts (timestamp_ntz), floor also before the origin."""
    origin = F.lit(ORIGIN).cast("timestamp_ntz")
    since = F.timestamp_diff("MICROSECOND", origin, ts)
    return F.timestamp_add("MICROSECOND", since - F.pmod(since, F.lit(width_us)), origin)
