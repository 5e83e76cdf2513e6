"""Resolution of read bounds: start, end, direction and limit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

#: The time that stands for none, and the limit where none is asked for.
NO_TIME = datetime(1601, 1, 1)
DEFAULT_LIMIT = 10_000


@dataclass(frozen=True)
class Bounds:
    start: datetime
    end: datetime
    descending: bool
    limit: int


def resolve(start: datetime | None, end: datetime | None, count: int | None, now: datetime) -> Bounds:
    """Absent starts read backwards, absent ends reach a day ahead, reversed (or equal) bounds swap."""
    descending = False
    if start is None or start == NO_TIME:
        start, descending = NO_TIME, True
    if end is None or end == NO_TIME:
        end = now + timedelta(days=1)
    if start >= end:
        start, end, descending = end, start, True
    return Bounds(start, end, descending, count or DEFAULT_LIMIT)
