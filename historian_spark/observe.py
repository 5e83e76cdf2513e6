"""Figures of writes, streams and caches, settings as nodes, and logs that do not flood."""

from __future__ import annotations

import logging
import time
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.node_ids import flatten


def timing(rows: DataFrame, key: str, duration: str, order: str) -> DataFrame:
    """count, total, last, max and avg of the durations of each key; last by order."""
    d = F.col(duration)
    return rows.groupBy(key).agg(F.count(d).alias("count"), F.sum(d).alias("total"), F.max_by(d, order).alias("last"), F.max(d).alias("max"), F.avg(d).alias("avg"))


class Meter:
    """Counters and timings of one writer."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.timings: dict[str, dict[str, float]] = {}

    def add(self, name: str, n: int = 1) -> None:
        self.counts[name] += n

    def took(self, name: str, ms: float) -> None:
        t = self.timings.setdefault(name, {"count": 0, "total_ms": 0.0, "last_ms": 0.0, "max_ms": 0.0, "avg_ms": 0.0})
        t["count"], t["total_ms"], t["last_ms"], t["max_ms"] = t["count"] + 1, t["total_ms"] + ms, ms, max(t["max_ms"], ms)
        t["avg_ms"] = t["total_ms"] / t["count"]

    def timed(self, name: str, f, *args):
        began = time.perf_counter()
        try:
            return f(*args)
        finally:
            self.took(name, 1000 * (time.perf_counter() - began))

    def report(self) -> dict:
        return {"counts": dict(self.counts), "timings": {k: dict(v) for k, v in self.timings.items()}}


def stream_report(query) -> dict:
    """Batches, rows and milliseconds of a streaming query, from its own progress."""
    meter = Meter()
    for p in query.recentProgress:
        meter.add("batches")
        meter.add("items", p["numInputRows"])
        meter.took("batch", p["durationMs"].get("triggerExecution", 0))
    return meter.report() | {"active": query.isActive}


def cache_levels(resolved: DataFrame) -> DataFrame:
    """How many requested series each level answered; resolved has a column level."""
    return resolved.groupBy("level").agg(F.count("*").alias("series"))


def settings_nodes(settings: dict) -> dict:
    """Nested settings or figures as flat names with dots."""
    return flatten(settings)


class Throttled(logging.Filter):
    """Lets everything pass in the first seconds of an outage, then one line a period that says how many it stands for."""

    def __init__(self, full_s: float = 600, period_s: float = 10, clock=time.monotonic):
        super().__init__()
        self.full_s, self.period_s, self.clock = full_s, period_s, clock
        self.began = self.last = None
        self.held = 0

    def recovered(self) -> None:
        self.began, self.held = None, 0

    def filter(self, record: logging.LogRecord) -> bool:
        now = self.clock()
        if self.began is None:
            self.began = now
        if now - self.began < self.full_s:
            self.last = now
            return True
        if now - self.last < self.period_s:
            self.held += 1
            return False
        if self.held:
            record.msg, record.args = f"{record.getMessage()} ({self.held} more like it)", ()
        self.last, self.held = now, 0
        return True
