"""Processed reads, roll-ups and reads at given times."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import time_bucket
from .reads import ntz


@dataclass(frozen=True)
class AggregatePlan:
    aggregate: str
    start: datetime
    end: datetime
    interval_ms: int = 60_000

    @classmethod
    def of(cls, start: datetime, end: datetime, aggregate: str | None = None, interval_ms: int | None = None) -> AggregatePlan:
        return cls(aggregate or "Average", start, end, interval_ms or 60_000)


def aggregate(name: str, value: Column, ts: Column) -> Column:
    """By name; averages over time are plain averages, and so is every unknown name."""
    known = {
        "Minimum": lambda: F.min(value), "Maximum": lambda: F.max(value), "Total": lambda: F.sum(value),
        "Count": lambda: F.count(value).cast("double"), "Start": lambda: F.min_by(value, ts), "End": lambda: F.max_by(value, ts),
    }
    return known.get(name, lambda: F.avg(value))()


def processed(rows: DataFrame, plan: AggregatePlan, key: str = "variable_id", ts: str = "sourcetimestamp", value: str = "value_double") -> DataFrame:
    """bucket, key, aggregate_value, sample_count of every series in the closed range."""
    own = rows.where(F.col(value).isNotNull() & F.col(ts).between(ntz(plan.start), ntz(plan.end)))
    bucket = time_bucket(F.col(ts), plan.interval_ms * 1000).alias("bucket")
    return own.groupBy(bucket, key).agg(aggregate(plan.aggregate, F.col(value), F.col(ts)).alias("aggregate_value"), F.count("*").alias("sample_count"))


def rollup(rows: DataFrame, width_ms: int = 3_600_000, *keys: str, ts: str = "event_timestamp") -> DataFrame:
    return rows.groupBy(time_bucket(F.col(ts), width_ms * 1000).alias("bucket"), *keys).agg(F.count("*").alias("event_count"))


def rollup_again(hourly: DataFrame, width_ms: int, *keys: str) -> DataFrame:
    """A coarser roll-up from the hourly one, instead of from the events."""
    return hourly.groupBy(time_bucket(F.col("bucket"), width_ms * 1000).alias("bucket"), *keys).agg(F.sum("event_count").alias("event_count"))


@dataclass(frozen=True)
class RefreshWindow:
    """How far behind the latest event a refresh goes, and how near to it."""

    start: timedelta = timedelta(hours=3)
    end: timedelta = timedelta(hours=1)
    width_ms: int = 3_600_000

    def bounds(self, now: datetime) -> tuple[Column, Column]:
        return tuple(time_bucket(ntz(now - x), self.width_ms * 1000) for x in (self.start, self.end))


def refresh(rollup_table, pending_table, events, batch: DataFrame, window: RefreshWindow, number: int, keys: tuple[str, ...] = ("source_id", "event_type"), job: str = "refresh") -> None:
    """Buckets that a batch's rows made invalid, counted anew from the stored events as far as they lie in the window.

    events is the table of stored events, with the batch's. Newer buckets wait in pending_table for
    a later batch; older ones are never counted again. Only the days of the invalid buckets are
    read, and only their counts are written; ``refreshed`` reads the latest counts of each bucket.
    """
    if rollup_table.done(job, number) and pending_table.done(job, number):
        return
    now = events.read().agg(F.max("event_timestamp")).first()[0]
    waited = pending_table.read()
    invalid = batch.select(time_bucket(F.col("event_timestamp"), window.width_ms * 1000).alias("bucket"))
    invalid = (invalid if waited is None else invalid.union(waited.select("bucket"))).distinct().persist()
    try:
        lo, hi = window.bounds(now)
        due = invalid.where((F.col("bucket") >= lo) & (F.col("bucket") < hi)).select("bucket", F.col("bucket").alias("event_timestamp"))
        later = invalid.where(F.col("bucket") >= hi)
        own = events.read_days_of(due).withColumn("bucket", time_bucket(F.col("event_timestamp"), window.width_ms * 1000))
        counted = own.join(due.select("bucket"), "bucket", "left_semi").groupBy("bucket", *keys).agg(F.count("*").alias("event_count"))
        # both take a numbered batch once, so one that ends between them is made whole when it is run again
        rollup_table.append(counted.withColumn("refreshed", F.lit(number).cast("long")), job, number)
        pending_table.replace(later, job, number)
    finally:
        invalid.unpersist()


def refreshed(rollup_table) -> DataFrame:
    """The counts of each bucket as of its last refresh."""
    rows = rollup_table.read()
    last = rows.groupBy("bucket").agg(F.max("refreshed").alias("refreshed"))
    return rows.join(last, ["bucket", "refreshed"]).drop("refreshed")


def at_times(requests: DataFrame, rows: DataFrame, key: str = "variable_id", ts: str = "sourcetimestamp", id_column: str = "value_id", value: str = "value_double", at: str = "at") -> DataFrame:
    """For each request (key, at) the last row at or before it; nulls where there is none.

    Requests and rows are one stream in order of time, read by days of a series, so that a long
    series is split over tasks; each day begins with the last row of the days before it, which
    is found on one row a day. However many requests there are, the rows are shuffled once.
    """
    seen = rows.select(key, F.col(ts).alias("t"), F.lit(0).alias("kind"), F.col(id_column).alias("id"), F.struct(F.col(ts).alias("ts"), F.col(id_column).alias("id"), F.col(value).alias("v")).alias("row"))
    asked = requests.select(key, F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast(seen.schema["row"].dataType).alias("row"))
    both = seen.unionByName(asked).withColumn("day", F.date_trunc("day", "t"))
    days = both.groupBy(key, "day").agg(F.max_by("row", F.when(F.col("kind") == 0, F.struct("t", "id"))).alias("last"))
    earlier = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "day", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    order = Window.partitionBy(key, "day").orderBy("t", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("row", F.last("row", ignorenulls=True).over(order)).where("kind = 1").alias("f")
    # a request without a time, or without a series, keeps its row too
    same = F.col("f.day").eqNullSafe(F.col("d.day")) & F.col(f"f.{key}").eqNullSafe(F.col(f"d.{key}"))
    filled = filled.join(days.alias("d"), same).select("f.*", "before")
    row = F.when(F.col("t").isNotNull() & F.col(key).isNotNull(), F.coalesce("row", "before"))
    return filled.select(key, F.col("t").alias(at), row["ts"].alias(ts), row["v"].alias(value))
