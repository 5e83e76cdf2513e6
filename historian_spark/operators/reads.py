"""History and event reads: range scans, keyset and offset pages, typed tables, latest values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bounds import Bounds
from ..plans.filters import compile_filter


def ntz(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def in_range(ts: Column, bounds: Bounds) -> Column:
    return ts.between(ntz(bounds.start), ntz(bounds.end))


def after_cursor(ts: str, id_column: str, cursor: tuple | None, descending: bool) -> Column:
    """Rows strictly behind the cursor (time, id) in the direction of reading; without id, ties are not resumed."""
    if cursor is None:
        return F.lit(True)
    at, last = ntz(cursor[0]), cursor[1]
    beyond = F.col(ts) < at if descending else F.col(ts) > at
    if last is None:
        return beyond
    tie = F.col(id_column) < last if descending else F.col(id_column) > last
    return beyond | ((F.col(ts) == at) & tie)


def page(rows: DataFrame, ts: str, id_column: str, descending: bool, limit: int, offset: int = 0) -> DataFrame:
    """The first rows in order of time and id; top-k, so only the page is moved."""
    order = [F.desc(ts), F.desc(id_column)] if descending else [F.asc(ts), F.asc(id_column)]
    ordered = rows.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def read_history(rows: DataFrame, series, bounds: Bounds, cursor: tuple | None = None, ts: str = "sourcetimestamp", key: str = "variable_id", id_column: str = "value_id") -> DataFrame:
    own = rows.where((F.col(key) == series) & in_range(F.col(ts), bounds) & after_cursor(ts, id_column, cursor, bounds.descending))
    return page(own, ts, id_column, bounds.descending, bounds.limit)


def read_events(rows: DataFrame, source, bounds: Bounds, elements: list[dict] | None = None, mode: str = "v2", cursor: tuple | None = None) -> DataFrame:
    """mode v1 limits, then filters; v2 filters, then limits."""
    own = rows.where((F.col("source_id") == source) & in_range(F.col("event_timestamp"), bounds) & after_cursor("event_timestamp", "event_id", cursor, bounds.descending))
    keep = compile_filter(elements, rows.schema)
    if mode == "v1":
        return page(own, "event_timestamp", "event_id", bounds.descending, bounds.limit).where(keep)
    return page(own.where(keep), "event_timestamp", "event_id", bounds.descending, bounds.limit)


def continuation(rows: list, limit: int, ts: str = "event_timestamp", id_column: str = "event_id") -> tuple | None:
    """The cursor behind a full page, none behind a short one."""
    return (rows[-1][ts], rows[-1][id_column]) if rows and len(rows) == limit else None


def join_typed(anchor: DataFrame, typed: DataFrame) -> DataFrame:
    return anchor.join(typed.drop("source_id"), ["event_id", "event_timestamp"])


def union_types(tables: list[DataFrame]) -> DataFrame:
    """All types in one frame; fields that a type lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def hydrate(rows: DataFrame, payload: DataFrame) -> DataFrame:
    """Payload for a page that was found on narrow columns."""
    return rows.join(payload, "legacy_row_id", "left")


def resolve_types(types: DataFrame, names: list[str]) -> DataFrame:
    """Types with one of the names, whole or behind the usual prefixes."""
    name = F.col("event_type_name")
    fits = [(name == n) | F.endswith(name, F.lit(f";s=Events.{n}")) | F.endswith(name, F.lit(f";s={n}")) for n in names]
    return types.where(reduce(lambda a, b: a | b, fits, F.lit(False)))


def resolve_each(types: DataFrame, names: list[str]) -> DataFrame:
    """One type for each name that has any: the whole name before the prefixed ones, then the least id; name, event_type_id, event_type_name."""
    asked = F.explode(F.array(*map(F.lit, names))).alias("name")
    rows = resolve_types(types, names).select("*", asked)
    whole = F.col("event_type_name") == F.col("name")
    fits = [F.endswith("event_type_name", F.concat(F.lit(p), "name")) for p in (";s=Events.", ";s=")]
    rank = F.struct(F.when(whole, 0).when(fits[0], 1).otherwise(2).alias("how"), "event_type_id")
    best = rows.where(whole | fits[0] | fits[1]).groupBy("name").agg(F.min_by(F.struct("event_type_id", "event_type_name"), rank).alias("t"))
    return best.select("name", "t.*")


def latest(rows: DataFrame, key: str, ts: str, id_column: str, *values: str, since=None) -> DataFrame:
    """The last row of each series, ties to the larger id; partial aggregates move, not rows."""
    rows = rows.where(F.col(ts) >= ntz(since)) if since is not None else rows
    best = rows.groupBy(key).agg(F.max_by(F.struct(ts, *values), F.struct(ts, id_column)).alias("last"))
    return best.select(key, f"last.{ts}", *[f"last.{v}" for v in values])


def metadata_page(meta: DataFrame, after, size: int, cap: int | None = None, key: str = "variable_id") -> DataFrame:
    """The next rows of a dimension behind a key, in its order; cap: the most that a caller will hold."""
    return meta.where(F.col(key) > after).orderBy(key).limit(size if cap is None else min(size, cap))


def latest_levels(requested: DataFrame, stored: DataFrame | None, history: DataFrame, key: str, ts: str, id_column: str, value: str, fallback: bool = True, since=None) -> DataFrame:
    """Every requested series once, with time, value and level: stored, history or none.

    since bounds how far back the history is asked; fallback=False does not ask it at all. Only
    series without a stored value are looked for there.
    """
    asked = requested.select(key).distinct()
    empty = history.select(key, ts, value).limit(0)
    held = (empty if stored is None else stored.select(key, ts, value)).withColumn("level", F.lit("stored"))
    found = asked.join(held, key, "left")
    if fallback:
        open_ = found.where("level is null").select(key)
        last = latest(history.join(open_, key, "left_semi"), key, ts, id_column, value, since=since)
        more = last.select(key, F.col(ts).alias("ht"), F.col(value).alias("hv"))
        found = found.join(more, key, "left").select(key, F.coalesce(ts, "ht").alias(ts), F.coalesce(value, "hv").alias(value), F.when(F.col("level").isNotNull(), F.col("level")).when(F.col("ht").isNotNull(), F.lit("history")).alias("level"))
    return found.withColumn("level", F.coalesce("level", F.lit("none")))


def healed(stored: DataFrame, levels: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """stored with the values that latest_levels found in the history, so that the next read finds them there."""
    new = levels.where("level = 'history'").select(key, ts, value)
    return stored.select(key, ts, value).unionByName(new)


def array_rows(spark, **arrays) -> DataFrame:
    """Parallel arrays of parameters as rows, a column each; shorter ones end in nulls."""
    one = spark.createDataFrame([tuple(arrays.values())], list(arrays))
    return one.select(F.inline(F.arrays_zip(*arrays)))


def selected(rows: DataFrame, clauses: list) -> DataFrame:
    """The fields that select clauses name, in their order; an unknown one is a column of nulls."""
    from ..plans.planner import field_name

    names = list(dict.fromkeys(field_name(c) for c in clauses))
    return rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]) if names else rows


def plan_text(rows: DataFrame) -> str:
    """The physical plan that Spark chose, with what is pushed to the scans."""
    return rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def latest_for(requested: DataFrame, stored: DataFrame | None, history: DataFrame, key: str, ts: str, id_column: str, value: str, fallback: bool = True) -> DataFrame:
    """Every requested series with its value: the stored one, else the history's last, else null."""
    found = requested.select(key).distinct()
    out, columns = found, []
    if stored is not None:
        out = out.join(stored.select(key, F.col(ts).alias("t0"), F.col(value).alias("v0")), key, "left")
        columns.append(("t0", "v0"))
    if fallback:
        last = latest(history.join(found, key, "left_semi"), key, ts, id_column, value)
        out = out.join(last.select(key, F.col(ts).alias("t1"), F.col(value).alias("v1")), key, "left")
        columns.append(("t1", "v1"))
    if not columns:
        return out.select(key, F.lit(None).cast("timestamp_ntz").alias(ts), F.lit(None).cast("double").alias(value))
    return out.select(key, F.coalesce(*[t for t, _ in columns]).alias(ts), F.coalesce(*[v for _, v in columns]).alias(value))


def byte_budget(rows: DataFrame, order: str, size: Column, budget: int, chunk: str | None = None) -> DataFrame:
    """Rows in order until the sum of sizes reaches the budget; the row that crosses it is in.

    Sums are taken per range of the order column first, so no task sees all rows.
    """
    sized = rows.withColumn("size", size).withColumn("chunk", F.floor(F.col(order) / 1024) if chunk is None else F.col(chunk))
    per_chunk = sized.groupBy("chunk").agg(F.sum("size").alias("own"))
    before = F.sum("own").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = per_chunk.select("chunk", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sized.join(base.where(F.col("base") < budget), "chunk").withColumn("before", F.col("base") + inside)
    return kept.where(F.col("before") < budget).select(*rows.columns, "size", "before")
