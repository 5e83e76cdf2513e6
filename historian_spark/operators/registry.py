"""Versioned schemas of event types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filters import expand_fields, legal_column

#: Fields that every event has and typed tables do not repeat.
COMMON_FIELDS = ("Time", "EventType", "SourceNode", "ReceiveTime", "LocalTime")


def next_version(current: list[str] | None, version: int, fields: list[str]) -> int:
    """The version for a field list: as it was if the list is equal, else one more."""
    return version if current == fields else version + 1 if current is not None else 1


def sync(schemas: DataFrame, event_type_id: int, fields: list[str]) -> DataFrame:
    """schemas with a type's field list: a new version if it is not the latest one, else as they were."""
    spark = schemas.sparkSession
    new = spark.createDataFrame([(event_type_id, fields)], "event_type_id int, fields array<string>")
    last = latest_schemas(schemas).select("event_type_id", "schema_version", F.col("fields").alias("had"))
    changed = new.join(last, "event_type_id", "left").where("had is null or had <> fields")
    fresh = changed.select("event_type_id", (F.coalesce("schema_version", F.lit(0)) + 1).alias("schema_version"), "fields")
    return schemas.unionByName(fresh.select([F.col(f.name).cast(f.dataType) for f in schemas.schema.fields]))


def found_fields(events: DataFrame, event_type: str = "event_type", payload: str = "props") -> DataFrame:
    """event_type and fields: the names in the JSON payloads of each type, sorted; names meet on the mappers first."""
    names = events.select(event_type, F.explode(F.json_object_keys(payload)).alias("field")).where(F.col("field") != "")
    return names.groupBy(event_type).agg(F.sort_array(F.collect_set("field")).alias("fields"))


def sync_found(schemas: DataFrame | None, found: DataFrame, key: str = "event_type") -> DataFrame:
    """schemas (key, schema_version, fields) with a new version of each type whose found fields are not its latest ones; all types at once."""
    if schemas is None:
        return found.select(key, F.lit(1).alias("schema_version"), "fields")
    last = schemas.groupBy(key).agg(F.max_by(F.struct("schema_version", "fields"), "schema_version").alias("had"))
    changed = found.join(last, key, "left").where("had is null or had.fields <> fields")
    return schemas.unionByName(changed.select(key, (F.coalesce("had.schema_version", F.lit(0)) + 1).alias("schema_version"), "fields"))


def register_events(house, batch: DataFrame, job: str = "schemas", number: int | None = None) -> bool:
    """The warehouse's schemas with what a batch of events adds: new versions only are written, a numbered batch once."""
    table = house.table("event_schemas")
    stored = table.read()
    synced = sync_found(stored, found_fields(batch))
    if stored is not None:
        synced = synced.join(stored.select("event_type", "schema_version"), ["event_type", "schema_version"], "left_anti")
    return table.append(synced, job, number)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored with rows in place of those of equal keys, and with the new ones."""
    return stored.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*stored.columns))


def allowed_fields(configured: set[str], schemas: DataFrame, aliases: dict[str, str] | None = None) -> set[str]:
    """The fields that a filter may ask for: the configured ones, else all of the latest schemas; a column a name, so few."""
    found = configured or {r["field"] for r in all_fields(schemas).collect()}
    return expand_fields(found, aliases)


def latest_schemas(schemas: DataFrame, key: str = "event_type_id") -> DataFrame:
    best = schemas.groupBy(key).agg(F.max_by(F.struct("schema_version", "fields"), "schema_version").alias("s"))
    return best.select(key, "s.schema_version", "s.fields")


def all_fields(schemas: DataFrame, key: str = "event_type_id") -> DataFrame:
    return latest_schemas(schemas, key).select(F.explode("fields").alias("field")).distinct()


def common_fields(schemas: DataFrame, key: str = "event_type_id") -> DataFrame:
    """Fields that all types have in their latest versions."""
    now = latest_schemas(schemas, key)
    n = now.agg(F.countDistinct(key).alias("n"))
    counts = now.select(key, F.explode("fields").alias("field")).groupBy("field").agg(F.countDistinct(key).alias("types"))
    return counts.join(F.broadcast(n), F.col("types") == F.col("n")).select("field")


def widen(rows: DataFrame, fields: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """rows with a text column for every legal field that they lack; common fields are skipped."""
    named = [(aliases or {}).get(f, f) for f in fields if f not in COMMON_FIELDS]
    return reduce(lambda df, c: df.withColumn(c, F.lit(None).cast("string")), [c for c in named if legal_column(c) and c not in rows.columns], rows)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)
