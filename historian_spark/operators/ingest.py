"""Ingestion as merges of frames: first write wins, last value wins, seeds, registration, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STORAGE_MODES = ("legacy", "dual", "v2")


def storage_mode(text: str | None) -> str:
    """A known mode, else dual."""
    mode = (text or "").strip().lower()
    return mode if mode in STORAGE_MODES else "dual"


def storage_mode_column(text: Column) -> Column:
    """A known mode, else dual."""
    mode = F.lower(F.trim(text))
    return F.when(mode.isin(*STORAGE_MODES), mode).otherwise(F.lit("dual"))


def first_write(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The earliest arrival of each key; partial aggregates move, one row a key and task."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), arrival).alias("first"))
    return best.select("first.*")


def first_new(stored: DataFrame, rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The earliest arrival of each key that stored lacks (nulls are equal). One aggregation over both: rows move once, and no task is sent all that is stored."""
    new = rows.select(*keys, F.col(arrival).alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast("boolean").alias("_held"))
    kinds = {f.name: f.dataType for f in new.schema.fields}
    old = stored.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in ("_at", "_row")], F.lit(True).alias("_held"))
    best = new.unionByName(old).groupBy(*keys).agg(F.min_by("_row", "_at").alias("_row"), F.max("_held").alias("_held"))
    return best.where("_held is null").select("_row.*")


def insert_new(target: DataFrame | None, rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Rows that the target does not hold yet, one a key."""
    fresh = first_write(rows, keys, arrival)
    return fresh if target is None else fresh.join(target.select(*keys), keys, "left_anti")


def last_value(rows: DataFrame, key: str, ts: str, arrival: str, *values: str) -> DataFrame:
    """The latest row of each series; of equal times the later arrival wins."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(ts, arrival, *values), F.struct(ts, arrival)).alias("b"))
    return best.select(key, "b.*")


def merge_last_values(stored: DataFrame, rows: DataFrame, key: str = "variable_id", ts: str = "sourcetimestamp", arrival: str = "arrival_seq", value: str = "value_double") -> DataFrame:
    """Stored values with new rows merged in: a seed or an older or equal time gives way."""
    new = last_value(rows, key, ts, arrival, value).select(key, F.col(ts).alias("nt"), F.col(value).alias("nv"))
    both = stored.select(key, ts, value, "is_seed").join(new, key, "full")
    wins = F.col("nt").isNotNull() & (F.col(ts).isNull() | F.coalesce(F.col("is_seed"), F.lit(False)) | (F.col(ts) <= F.col("nt")))
    return both.select(key, F.when(wins, F.col("nt")).otherwise(F.col(ts)).alias(ts), F.when(wins, F.col("nv")).otherwise(F.col(value)).alias(value), F.when(wins, F.lit(False)).otherwise(F.col("is_seed")).alias("is_seed"))


def seed_missing(stored: DataFrame, seeds: DataFrame, key: str = "variable_id", position: str | None = None) -> DataFrame:
    """Seeds for series without a stored value; of several for one series the first by position, if there is such a column."""
    new = seeds.join(stored.select(key), key, "left_anti")
    new = new.dropDuplicates([key]) if position is None else first_write(new, [key], position)
    return new.withColumn("is_seed", F.lit(True))


def backfill_seeds(stored: DataFrame, history: DataFrame, key: str = "variable_id", ts: str = "sourcetimestamp", id_column: str = "value_id", value: str = "value_double") -> DataFrame:
    """Seeds replaced by the history's last values where there are any; no row stays a seed."""
    last = last_value(history, key, ts, id_column, value).select(key, F.col(ts).alias("ht"), F.col(value).alias("hv"))
    both = stored.join(last, key, "left")
    found = F.col("is_seed") & F.col("ht").isNotNull()
    return both.select(key, F.when(found, F.col("ht")).otherwise(F.col(ts)).alias(ts), F.when(found, F.col("hv")).otherwise(F.col(value)).alias(value), F.lit(False).alias("is_seed"), found.alias("restored"))


CHUNK = 4096  # positions that are numbered in one task


def numbered(rows: DataFrame, position: str, name: str) -> DataFrame:
    """rows with a number from 1 in order of position: counted by ranges of positions first, so no task sees all rows."""
    ranged = rows.withColumn("chunk", F.floor(F.col(position) / CHUNK))
    before = F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # a row a chunk
    base = ranged.groupBy("chunk").agg(F.count("*").alias("n")).select("chunk", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("chunk").orderBy(position))
    return ranged.withColumn("inside", inside).join(base, "chunk").withColumn(name, F.col("base") + F.col("inside")).drop("chunk", "base", "inside")


def register(dimension: DataFrame, nodes: DataFrame, reset_type: bool) -> DataFrame:
    """Upsert of nodes by node_id; registering one node resets its type to Unknown, in bulk it stays. New ids follow the largest."""
    ranked = nodes.groupBy("node_id").agg(F.min("position").alias("position"))
    known = dimension.join(ranked.select("node_id", F.lit(True).alias("again")), "node_id", "left")
    kept = known.withColumn("data_type", F.when(F.col("again") & F.lit(reset_type), F.lit("Unknown")).otherwise(F.col("data_type"))).drop("again")
    new = ranked.join(dimension.select("node_id"), "node_id", "left_anti")
    top = dimension.agg(F.coalesce(F.max("variable_id"), F.lit(0)).alias("top"))
    fresh = numbered(new, "position", "nth").crossJoin(F.broadcast(top)).withColumn("variable_id", F.col("top") + F.col("nth"))  # top is one row
    return kept.unionByName(fresh.select("node_id", "variable_id", F.lit("Unknown").alias("data_type")), allowMissingColumns=True)


def touch(dimension: DataFrame, names: DataFrame, key: str, id_column: str, now: Column) -> DataFrame:
    """Event sources or types by name: known ones get now as updated_at, new ones the next ids in order of their names' positions."""
    asked = names.groupBy(key).agg(F.min("position").alias("position"))
    known = dimension.join(asked.select(key, F.lit(True).alias("again")), key, "left")
    kept = known.withColumn("updated_at", F.when(F.col("again"), now).otherwise(F.col("updated_at"))).drop("again")
    top = dimension.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top"))
    new = numbered(asked.join(dimension.select(key), key, "left_anti"), "position", "nth").crossJoin(F.broadcast(top))  # top is one row
    return kept.unionByName(new.select(key, (F.col("top") + F.col("nth")).alias(id_column), now.alias("updated_at")))


def valid_events(rows: DataFrame, now: Column) -> DataFrame:
    """Events with a source and a type; the time is Time, else time, else the event_timestamp that came with it, else now."""
    named = [F.col(c) for c in ("Time", "time", "event_timestamp") if c in rows.columns]
    return rows.where("source_id is not null and event_type is not null").withColumn("event_timestamp", F.coalesce(*named, now))


def skip_first(rows: DataFrame, key: str, ts: str, id_column: str) -> DataFrame:
    """Without the first notification of each series after registration; the firsts are aggregated, no series is sorted."""
    first = rows.groupBy(key).agg(F.min(F.struct(ts, id_column)).alias("first"))
    return rows.join(first, key).where(F.struct(ts, id_column) > F.col("first")).select(*rows.columns)


def missing_anchors(legacy: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    return legacy.join(anchors.select(*keys), keys, "left_anti")


def coverage(legacy: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """lag, total and coverage_pct (two decimals, 0 when there is nothing) of anchors over legacy rows."""
    marked = legacy.join(anchors.select(*keys, F.lit(1).alias("has")).distinct(), keys, "left")
    sums = marked.agg(F.count("*").alias("total"), F.count("has").alias("covered"))
    pct = F.when(F.col("total") > 0, F.round(100.0 * F.col("covered") / F.col("total"), 2)).otherwise(F.lit(0.0))
    return sums.select((F.col("total") - F.col("covered")).alias("lag"), "total", pct.alias("coverage_pct"))
