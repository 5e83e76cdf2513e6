"""Reads of typed event tables, of one type or of several, with filter, cursor, order and limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import planner
from ..plans.bounds import Bounds
from ..plans.filters import compile_filter
from .reads import after_cursor, in_range, join_typed, page


def _alike(tables: list[DataFrame]) -> set[str]:
    """Columns that have one type in all tables that have them."""
    kinds: dict[str, set] = {}
    for df in tables:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    return {name for name, found in kinds.items() if len(found) == 1}


def read_typed(anchor: DataFrame, typed: dict[str, DataFrame], types: list[str] | None, bounds: Bounds, elements: list[dict] | None = None, source=None, cursor: tuple | None = None) -> DataFrame:
    """Events of the given types (None: of all) with their fields, filtered, then in order up to the limit.

    A type without a table has no rows here. Types are united with nulls for the fields that they
    lack, so the whole filter sees every event of every type. Before that its plan is asked: types
    that cannot fit are not read, and conditions that hold on the anchor's columns or on a type's
    own fields alone go to their scans, also from beneath Or.
    """
    wanted = sorted(typed) if types is None else [t for t in types if t in typed]
    plan = planner.build(elements, aliases={"event_type": planner.EVENT_TYPE})
    wanted = plan.possible(wanted)
    own = anchor.where(in_range(F.col("event_timestamp"), bounds) & after_cursor("event_timestamp", "event_id", cursor, bounds.descending))
    own = own if source is None else own.where(F.col("source_id") == source)
    if not wanted:
        lacking = {f.name: f.dataType for df in typed.values() for f in df.schema.fields if f.name not in anchor.columns}
        return own.limit(0).select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in lacking.items()])
    own = own.where(plan.column(anchor.schema, {planner.EVENT_TYPE: "event_type"}))
    alike = _alike([typed[t] for t in wanted])

    def branch(t: str) -> DataFrame:
        fields = T.StructType([f for f in typed[t].schema.fields if f.name in alike and f.name not in anchor.columns])
        return join_typed(own.where(F.col("event_type") == t), typed[t].where(plan.column(fields)))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(branch, wanted))
    return page(rows.where(compile_filter(elements, rows.schema)), "event_timestamp", "event_id", bounds.descending, bounds.limit)
