"""The registered queries of the historian, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import observe
from .functions import node_ids, payload
from .functions.buckets import time_bucket
from .operators import backfill, ingest, reads, registry, retention, temporal, typed, writes
from .plans import bounds, filters, planner
from .plans.filters import attribute, compile_filter, element, literal, ref, type_filter
from .sources import tables as src
from .sources.warehouse import Table, Warehouse, probe
from .streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

START, END, NOW = datetime(2024, 1, 5), datetime(2024, 1, 25), datetime(2024, 2, 1)
BETWEEN = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"
VARS = "(SELECT event_id AS value_id, user_id AS variable_id, ts AS sourcetimestamp, value AS value_double FROM events)"
ANCHOR = "(SELECT event_id, user_id AS source_id, event_type, ts AS event_timestamp, 1 AS schema_version, event_id AS legacy_row_id FROM events)"
DUP = "(SELECT o_custkey AS variable_id, o_orderdate AS sourcetimestamp, o_totalprice AS value_double, o_orderkey AS arrival_seq FROM orders)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _bounds(start=START, end=END, count=None) -> bounds.Bounds:
    return bounds.resolve(start, end, count, NOW)


# raw history: bounds, direction, limit, pages
def _raw(name: str, b: bounds.Bounds, where: str, order: str, limit: int, cursor=None) -> None:
    @query(name, f"SELECT value_id, variable_id, sourcetimestamp, value_double FROM {VARS} WHERE variable_id = 5 AND {where.replace('ts ', 'sourcetimestamp ')} ORDER BY sourcetimestamp {order}, value_id {order} LIMIT {limit}")
    def run(spark, d):
        return reads.read_history(src.variables(spark, d), 5, b, cursor)


_raw("raw_history_asc", _bounds(count=50), BETWEEN, "ASC", 50)
_raw("raw_history_desc", _bounds(None, END, 50), "ts <= TIMESTAMP '2024-01-25'", "DESC", 50)
_raw("raw_history_swapped_bounds", _bounds(END, START, 50), BETWEEN, "DESC", 50)
_raw("raw_history_default_limit", _bounds(None, None, 0), "ts <= TIMESTAMP '2024-02-02'", "DESC", 10000)
_CUT = "2024-01-15 00:00:00"
_raw("raw_history_page2_keyset", _bounds(None, END, 20), f"ts <= TIMESTAMP '2024-01-25' AND ts < TIMESTAMP '{_CUT}'", "DESC", 20, (_CUT, None))
_raw("raw_history_keyset_asc", _bounds(count=20), f"{BETWEEN} AND (sourcetimestamp > TIMESTAMP '{_CUT}' OR (sourcetimestamp = TIMESTAMP '{_CUT}' AND value_id > 7))", "ASC", 20, (_CUT, 7))


@query("history_offset_page", f"SELECT * FROM {VARS} ORDER BY variable_id, sourcetimestamp, value_id LIMIT 100 OFFSET 200")
def history_offset_page(spark, d):
    return src.variables(spark, d).orderBy("variable_id", "sourcetimestamp", "value_id").offset(200).limit(100)


@query("metadata_keyset_page", "SELECT c_custkey AS variable_id, 'ns=2;i=' || c_custkey AS node_id, 'Double' AS data_type FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 50")
def metadata_keyset_page(spark, d):
    return reads.metadata_page(src.variable_metadata(spark, d), 40, 500, cap=50)


@query("cache_byte_budget", "SELECT variable_id, size, before FROM (SELECT c_custkey AS variable_id, length(c_name) + 128 AS size, CAST(coalesce(sum(length(c_name) + 128) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM customer) WHERE before < 20000")
def cache_byte_budget(spark, d):
    rows = src.table(spark, d, "customer").select(F.col("c_custkey").alias("variable_id"), "c_name")
    return reads.byte_budget(rows, "variable_id", F.length("c_name") + 128, 20000).select("variable_id", "size", "before")


# events
@query("event_scan_anchor", f"SELECT * FROM {ANCHOR} WHERE source_id = 5 AND {BETWEEN.replace('ts ', 'event_timestamp ')} ORDER BY event_timestamp, event_id LIMIT 100")
def event_scan_anchor(spark, d):
    return reads.read_events(src.event_anchor(spark, d), 5, _bounds(count=100))


@query("event_scan_types", f"SELECT * FROM {ANCHOR} WHERE source_id = 5 AND event_type IN ('error', 'purchase') AND {BETWEEN.replace('ts ', 'event_timestamp ')} ORDER BY event_timestamp, event_id LIMIT 100")
def event_scan_types(spark, d):
    return reads.read_events(src.event_anchor(spark, d), 5, _bounds(count=100), type_filter(["error", "purchase"]))


@query("event_limit_then_filter", f"SELECT * FROM (SELECT * FROM {ANCHOR} WHERE source_id = 5 AND event_timestamp <= TIMESTAMP '2024-02-02' ORDER BY event_timestamp DESC, event_id DESC LIMIT 30) WHERE event_type IN ('error')")
def event_limit_then_filter(spark, d):
    return reads.read_events(src.event_anchor(spark, d), 5, _bounds(None, None, 30), type_filter(["error"]), mode="v1")


@query("event_filter_then_limit", f"SELECT * FROM {ANCHOR} WHERE source_id = 5 AND event_timestamp <= TIMESTAMP '2024-02-02' AND event_type IN ('error') ORDER BY event_timestamp DESC, event_id DESC LIMIT 30")
def event_filter_then_limit(spark, d):
    return reads.read_events(src.event_anchor(spark, d), 5, _bounds(None, None, 30), type_filter(["error"]))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Range read of one source with a compiled filter, ordered and limited."""
    rows = src.table(spark, d, "events").select("event_id", F.col("user_id").alias("source_id"), "event_type", F.col("ts").alias("event_timestamp"), "value")
    spec = [*type_filter(["error", "purchase"]), element("GreaterThan", attribute("value"), literal(5.0)), element("And", ref(0), ref(1))]
    return reads.read_events(rows, 5, _bounds(None, None, 100), spec)


query("event_history_flagship", "SELECT event_id, user_id AS source_id, event_type, ts AS event_timestamp, value FROM events WHERE user_id = 5 AND event_type IN ('error', 'purchase') AND value > 5 AND ts <= TIMESTAMP '2024-02-02' ORDER BY ts DESC, event_id DESC LIMIT 100")(flagship)


@query("typed_single_type", "SELECT event_id, ts AS event_timestamp, user_id AS source_id, event_type, props->>'$.k' AS k, value FROM events WHERE event_type = 'error' AND value > 100")
def typed_single_type(spark, d):
    typed = src.typed_events(spark, d, "error").where("value > 100")
    return reads.join_typed(src.event_anchor(spark, d), typed).select("event_id", "event_timestamp", "source_id", "event_type", "k", "value")


@query("typed_union_types", "SELECT event_id, ts AS event_timestamp, user_id AS source_id, event_type, props->>'$.k' AS k, value FROM events WHERE event_type IN ('error', 'signup') AND (props->>'$.k') ILIKE '%1%'")
def typed_union_types(spark, d):
    both = reads.union_types([src.typed_events(spark, d, t) for t in ("error", "signup")]).where(F.col("k").ilike("%1%"))
    return reads.join_typed(src.event_anchor(spark, d), both).select("event_id", "event_timestamp", "source_id", "event_type", "k", "value")


# the filter language, one query an operator
_V, _T, _K = attribute("value"), attribute("event_type"), attribute("k")
_FILTERS = {
    "eq": ([element("Equals", _T, literal("click"))], "event_type = 'click'"),
    "gt": ([element("GreaterThan", _V, literal(100.0))], "value > 100"),
    "lt": ([element("LessThan", _V, literal(100))], "value < 100"),
    "ge": ([element("GreaterThanOrEqual", _V, literal(250))], "value >= 250"),
    "le": ([element("LessThanOrEqual", _V, literal(250.0))], "value <= 250"),
    "in": ([element("InList", _T, literal("error"), literal("signup"))], "event_type IN ('error', 'signup')"),
    "between": ([element("Between", _V, literal(10.0), literal(20.0))], "value BETWEEN 10 AND 20"),
    "like": ([element("Like", _T, literal("%li_k"))], "event_type LIKE '%li_k'"),
    "ilike": ([element("ILike", _T, literal("*ERR?R"))], "event_type ILIKE '%ERR_R'"),
    "isnull": ([element("IsNull", _K)], "k IS NULL"),
    "and": ([element("GreaterThan", _V, literal(50.0)), element("Equals", _T, literal("view")), element("And", ref(0), ref(1))], "value > 50 AND event_type = 'view'"),
    "or": ([element("GreaterThan", _V, literal(200.0)), element("Equals", _T, literal("view")), element("Or", ref(0), ref(1))], "value > 200 OR event_type = 'view'"),
    "not": ([element("Equals", _K, literal("3")), element("Not", ref(0))], "NOT coalesce(k = '3', false)"),
    "unknown_operator": ([element("InView", _V)], "true"),
    "missing_attribute": ([element("IsNull", attribute("no_such"))], "true"),
    "coerce_string": ([element("Equals", _K, literal(7))], "k = '7'"),
    "nested": ([element("Equals", _T, literal("error")), element("Not", ref(0)), element("LessThan", _V, literal(5)), element("And", ref(1), ref(2))], "NOT coalesce(event_type = 'error', false) AND value < 5"),
}


def _filter(name: str, spec: list[dict], where: str) -> None:
    @query(f"filter_{name}", f"SELECT event_id, event_type, value, k FROM (SELECT *, props->>'$.k' AS k FROM events) WHERE {where}")
    def run(spark, d):
        rows = src.table(spark, d, "events").select("event_id", "event_type", "value", payload.field(F.col("props"), "k").alias("k"))
        return rows.where(compile_filter(spec, rows.schema))


for _name, (_spec, _where) in _FILTERS.items():
    _filter(_name, _spec, _where)


@query("type_name_resolution", "SELECT event_type_id, event_type_name FROM (SELECT CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS event_type_id, 'ns=2;s=Events.' || event_type AS event_type_name FROM (SELECT DISTINCT event_type FROM events)) WHERE event_type_name LIKE '%;s=Events.error' OR event_type_name LIKE '%;s=Events.view'")
def type_name_resolution(spark, d):
    return reads.resolve_types(src.event_types(spark, d), ["error", "view"])


@query("late_materialised_page", f"SELECT a.event_id, a.event_timestamp, e.value, e.props FROM (SELECT * FROM {ANCHOR} WHERE source_id = 7 ORDER BY event_timestamp DESC, event_id DESC LIMIT 25) a LEFT JOIN events e ON e.event_id = a.legacy_row_id")
def late_materialised_page(spark, d):
    found = reads.read_events(src.event_anchor(spark, d), 7, _bounds(None, None, 25))
    return reads.hydrate(found, src.event_payload(spark, d)).select("event_id", "event_timestamp", "value", "props")


# latest values
@query("latest_per_series", "SELECT user_id AS variable_id, max(ts) AS sourcetimestamp, arg_max(value, (ts, event_id)) AS value_double FROM events GROUP BY user_id")
def latest_per_series(spark, d):
    return reads.latest(src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id", "value_double")


@query("latest_lookback", "SELECT user_id AS variable_id, max(ts) AS sourcetimestamp, arg_max(value, (ts, event_id)) AS value_double FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY user_id")
def latest_lookback(spark, d):
    return reads.latest(src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id", "value_double", since="2024-01-29")


@query("latest_with_fallback_missing", "SELECT c_custkey AS variable_id, max(ts) AS sourcetimestamp, arg_max(value, (ts, event_id)) AS value_double FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def latest_with_fallback_missing(spark, d):
    asked = src.variable_metadata(spark, d).select("variable_id")
    return reads.latest_for(asked, None, src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id", "value_double")


# at given times and in buckets
@query("at_time_asof", "SELECT r.variable_id, r.at, s.ts AS sourcetimestamp, s.value AS value_double FROM (SELECT u AS variable_id, t AS at FROM (SELECT DISTINCT user_id AS u FROM events), unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL 12 HOUR)) AS g(t)) r ASOF LEFT JOIN events s ON r.variable_id = s.user_id AND r.at >= s.ts")
def at_time_asof(spark, d):
    rows = src.variables(spark, d)
    grid = F.sequence(reads.ntz("2023-12-31"), reads.ntz("2024-02-01"), F.expr("interval 12 hours"))
    return temporal.at_times(rows.select("variable_id").distinct().withColumn("at", F.explode(grid)), rows)


_SQL_AGG = {
    "average": ("Average", "round(avg(value), 6)"), "timeaverage": ("TimeAverage", "round(avg(value), 6)"), "unknown_name": ("Variance", "round(avg(value), 6)"),
    "min": ("Minimum", "min(value)"), "max": ("Maximum", "max(value)"), "total": ("Total", "round(sum(value), 6)"),
    "count": ("Count", "CAST(count(value) AS DOUBLE)"), "start": ("Start", "arg_min(value, ts)"), "end": ("End", "arg_max(value, ts)"),
}


def _processed(name: str, aggregate: str, expression: str, width_ms: int, width: str) -> None:
    @query(name, f"SELECT time_bucket(INTERVAL '{width}', ts) AS bucket, user_id AS variable_id, {expression} AS aggregate_value, count(*) AS sample_count FROM events WHERE {BETWEEN} GROUP BY 1, 2")
    def run(spark, d):
        rows = temporal.processed(src.variables(spark, d), temporal.AggregatePlan.of(START, END, aggregate, width_ms))
        # sums of doubles differ in their last places with the order of rows
        return rows.withColumn("aggregate_value", F.round("aggregate_value", 6)) if expression.startswith("round") else rows


for _name, (_agg, _sql) in _SQL_AGG.items():
    _processed(f"processed_{_name}", _agg, _sql, 6 * 3_600_000, "6 hours")
_processed("processed_7min_origin", "Average", _SQL_AGG["average"][1], 7 * 60_000, "7 minutes")
_processed("processed_7day_origin", "Maximum", "max(value)", 7 * 86_400_000, "7 days")
_HOURLY = "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, user_id AS source_id, event_type, count(*) AS event_count FROM events GROUP BY 1, 2, 3"


@query("hourly_event_rollup", _HOURLY)
def hourly_event_rollup(spark, d):
    return temporal.rollup(src.event_anchor(spark, d), 3_600_000, "source_id", "event_type")


@query("daily_from_hourly_rollup", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(*) AS event_count FROM events GROUP BY 1, 2")
def daily_from_hourly_rollup(spark, d):
    return temporal.rollup_again(hourly_event_rollup(spark, d), 86_400_000, "event_type")


# ingestion
@query("dedup_first_write", f"SELECT variable_id, sourcetimestamp, value_double, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY variable_id, sourcetimestamp ORDER BY arrival_seq) AS nth FROM {DUP}) WHERE nth = 1")
def dedup_first_write(spark, d):
    return ingest.first_write(src.variables_dup(spark, d), ["variable_id", "sourcetimestamp"], "arrival_seq")


@query("insert_ignoring_conflicts", f"SELECT variable_id, sourcetimestamp, value_double, arrival_seq FROM (SELECT *, row_number() OVER (PARTITION BY variable_id, sourcetimestamp ORDER BY arrival_seq) AS nth FROM {DUP} WHERE variable_id >= 20) n WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM {DUP} o WHERE o.variable_id < 500 AND o.variable_id = n.variable_id AND o.sourcetimestamp = n.sourcetimestamp)")
def insert_ignoring_conflicts(spark, d):
    rows = src.variables_dup(spark, d)
    return ingest.insert_new(rows.where("variable_id < 500"), rows.where("variable_id >= 20"), ["variable_id", "sourcetimestamp"], "arrival_seq")


@query("last_value_upsert", f"SELECT variable_id, max(sourcetimestamp) AS sourcetimestamp, max((sourcetimestamp, arrival_seq)).arrival_seq AS arrival_seq, arg_max(value_double, (sourcetimestamp, arrival_seq)) AS value_double FROM (SELECT *, (sourcetimestamp, arrival_seq) AS x FROM {DUP}) GROUP BY variable_id".replace("max((sourcetimestamp, arrival_seq)).arrival_seq", "arg_max(arrival_seq, (sourcetimestamp, arrival_seq))"))
def last_value_upsert(spark, d):
    return ingest.last_value(src.variables_dup(spark, d), "variable_id", "sourcetimestamp", "arrival_seq", "value_double")


_STORED = f"(SELECT variable_id, TIMESTAMP '2024-01-01' AS sourcetimestamp, CAST(-1 AS DOUBLE) AS value_double, variable_id % 2 = 0 AS is_seed FROM {DUP} GROUP BY variable_id)"


@query("last_value_tie_later_wins", f"SELECT s.variable_id, CASE WHEN s.is_seed OR s.sourcetimestamp <= n.t THEN n.t ELSE s.sourcetimestamp END AS sourcetimestamp, CASE WHEN s.is_seed OR s.sourcetimestamp <= n.t THEN n.v ELSE s.value_double END AS value_double, CASE WHEN s.is_seed OR s.sourcetimestamp <= n.t THEN false ELSE s.is_seed END AS is_seed FROM {_STORED} s JOIN (SELECT variable_id, max(sourcetimestamp) AS t, arg_max(value_double, (sourcetimestamp, arrival_seq)) AS v FROM {DUP} GROUP BY variable_id) n USING (variable_id)")
def last_value_tie_later_wins(spark, d):
    rows = src.variables_dup(spark, d)
    stored = rows.select("variable_id").distinct().select("variable_id", reads.ntz("2024-01-01").alias("sourcetimestamp"), F.lit(-1.0).alias("value_double"), (F.col("variable_id") % 2 == 0).alias("is_seed"))
    return ingest.merge_last_values(stored, rows)


_SEEDS = "SELECT c_custkey AS variable_id, TIMESTAMP '2023-01-01' AS sourcetimestamp, CAST(0 AS DOUBLE) AS value_double, true AS is_seed FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"


def _seeds(spark, d):
    seeds = src.variable_metadata(spark, d).select("variable_id", reads.ntz("2023-01-01").alias("sourcetimestamp"), F.lit(0.0).alias("value_double"))
    return seeds


@query("seed_missing_series", _SEEDS)
def seed_missing_series(spark, d):
    return ingest.seed_missing(src.variables(spark, d), _seeds(spark, d))


@query("backfill_seeds", "SELECT c_custkey AS variable_id, coalesce(max(ts), TIMESTAMP '2023-01-01') AS sourcetimestamp, coalesce(arg_max(value, (ts, event_id)), 0) AS value_double, false AS is_seed, max(ts) IS NOT NULL AS restored FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def backfill_seeds(spark, d):
    return ingest.backfill_seeds(_seeds(spark, d).withColumn("is_seed", F.lit(True)), src.variables(spark, d))


@query("skip_initial_notification", f"SELECT variable_id, sourcetimestamp, value_double, value_id FROM (SELECT *, row_number() OVER (PARTITION BY variable_id ORDER BY sourcetimestamp, value_id) AS nth FROM {VARS}) WHERE nth > 1")
def skip_initial_notification(spark, d):
    return ingest.skip_first(src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id")


@query("register_nodes_bulk", "SELECT c_custkey AS variable_id, 'ns=2;i=' || c_custkey AS node_id, 'Double' AS data_type FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY r_regionkey), 'ns=2;s=' || r_name, 'Unknown' FROM region")
def register_nodes_bulk(spark, d):
    meta = src.variable_metadata(spark, d)
    new = src.table(spark, d, "region").select(F.concat(F.lit("ns=2;s="), "r_name").alias("node_id"), F.col("r_regionkey").alias("position"))
    again = meta.where("variable_id < 5").select("node_id", F.col("variable_id").cast("int").alias("position"))
    return ingest.register(meta, new.unionByName(again), reset_type=False).select(F.col("variable_id").cast("long").alias("variable_id"), "node_id", "data_type")


@query("anchor_lag", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events a WHERE a.event_id = e.event_id AND a.event_type <> 'view')")
def anchor_lag(spark, d):
    e = src.table(spark, d, "events").select("event_id")
    return ingest.missing_anchors(e, src.event_anchor(spark, d).where("event_type <> 'view'"), ["event_id"])


@query("coverage_pct", "SELECT count(*) FILTER (event_type = 'view') AS lag, count(*) AS total, round(100.0 * count(*) FILTER (event_type <> 'view') / count(*), 2) AS coverage_pct FROM events")
def coverage_pct(spark, d):
    e = src.table(spark, d, "events").select("event_id")
    return ingest.coverage(e, src.event_anchor(spark, d).where("event_type <> 'view'"), ["event_id"])


@query("semi_join_storage", "SELECT event_id FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 480)")
def semi_join_storage(spark, d):
    e = src.table(spark, d, "events")
    return e.join(e.where("value > 480").select("event_type").distinct(), "event_type", "left_semi").select("event_id")


# schema registry
# payloads whose fields depend on the event and on its time; schemas are what is found in three thirds of a month
_FIELDS = {"k": "true", "high": "value > 100", "tag": "user_id % 7 = 0 AND event_type <> 'click'", "mid": "day(ts) > 10 AND event_type <> 'view'", "late": "day(ts) > 20 AND event_type IN ('error', 'view')"}
_THIRD = "CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END"
_FOUND = "(SELECT event_type, part, list_sort(list(DISTINCT field)) AS fields FROM (" + " UNION ALL ".join(f"SELECT event_type, {_THIRD} AS part, '{f}' AS field FROM events WHERE {c}" for f, c in _FIELDS.items()) + ") GROUP BY 1, 2)"
_CHANGED = f"(SELECT * FROM (SELECT *, lag(fields) OVER (PARTITION BY event_type ORDER BY part) AS had FROM {_FOUND}) WHERE had IS NULL OR had <> fields)"
_SCHEMAS = f"(SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY part) AS INTEGER) AS schema_version, fields FROM {_CHANGED})"
_LATEST = f"(SELECT event_type, max(schema_version) AS schema_version, arg_max(fields, schema_version) AS fields FROM {_SCHEMAS} GROUP BY 1)"


def _with_fields(spark, d):
    rows = src.table(spark, d, "events")
    values = [F.when(F.expr(c), F.lit("x")).alias(f) for f, c in _FIELDS.items()]
    return rows.withColumn("props", F.to_json(F.struct(*values))).withColumn("part", F.expr(_THIRD))


def _schemas(spark, d):
    """The registry after the three thirds, each synced as a batch of the warehouse."""
    house, rows = _house(spark), _with_fields(spark, d)
    for part in (1, 2, 3):
        for _ in range(2 if part == 2 else 1):  # a batch that comes twice adds nothing
            registry.register_events(house, rows.where(F.col("part") == part), number=part)
    return house.table("event_schemas").read()


@query("schema_sync", f"SELECT event_type, schema_version, array_to_string(fields, ',') AS fields FROM {_SCHEMAS}")
def schema_sync(spark, d):
    return _schemas(spark, d).withColumn("fields", F.array_join("fields", ","))


@query("schema_latest_per_type", f"SELECT event_type, schema_version, array_to_string(fields, ',') AS fields FROM {_LATEST}")
def schema_latest_per_type(spark, d):
    return registry.latest_schemas(_schemas(spark, d), "event_type").withColumn("fields", F.array_join("fields", ","))


@query("field_union", f"SELECT DISTINCT unnest(fields) AS field FROM {_LATEST}")
def field_union(spark, d):
    return registry.all_fields(_schemas(spark, d), "event_type")


@query("field_intersection", f"SELECT field FROM (SELECT event_type, unnest(fields) AS field FROM {_LATEST}) GROUP BY field HAVING count(*) = (SELECT count(*) FROM {_LATEST})")
def field_intersection(spark, d):
    return registry.common_fields(_schemas(spark, d), "event_type")


@query("configured_fields", f"SELECT event_type, field, count(*) AS events FROM ({' UNION ALL '.join(f"SELECT event_type, '{f}' AS field FROM events WHERE {c}" for f, c in _FIELDS.items())}) WHERE field IN ('high', 'late', 'tag') GROUP BY 1, 2")
def configured_fields(spark, d):
    """The fields of payloads that the configuration allows, also by an alias; malformed aliases are skipped."""
    rows = _with_fields(spark, d)
    allowed = registry.allowed_fields(filters.parse_csv_set(" tag, elevated ,late,"), rows, filters.parse_aliases("elevated:high, bad, :x"))
    names = rows.select("event_type", F.explode(F.json_object_keys("props")).alias("field"))
    return names.where(F.col("field").isin(sorted(allowed))).groupBy("event_type", "field").agg(F.count("*").alias("events"))


@query("schema_evolution_union", "SELECT event_id, value, NULL::VARCHAR AS k FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value, props->>'$.k' FROM events WHERE event_type = 'signup'")
def schema_evolution_union(spark, d):
    old = src.typed_events(spark, d, "click").select("event_id", "value")
    return registry.evolve(registry.widen(old, ["k", "x-y", "Time"]), src.typed_events(spark, d, "signup").select("event_id", "value", "k"))


@query("payload_json_extract", "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1")
def payload_json_extract(spark, d):
    return src.table(spark, d, "events").groupBy(payload.decode_payload(F.col("props"))["k"].alias("k")).agg(F.count("*").alias("n"))


@query("payload_base64_roundtrip", "SELECT event_id, 'base64:' || base64(encode(props)) AS encoded, props AS decoded FROM events")
def payload_base64_roundtrip(spark, d):
    rows = src.table(spark, d, "events").select("event_id", payload.encode_value(F.col("props")).alias("encoded"))
    return rows.withColumn("decoded", payload.decode_value(F.col("encoded")))


# retention and administration
@query("retention_age", f"SELECT * FROM {VARS} WHERE sourcetimestamp >= TIMESTAMP '2024-01-20'")
def retention_age(spark, d):
    return retention.keep_since(src.variables(spark, d), "sourcetimestamp", "2024-01-20")


@query("retention_keep_newest_n", f"SELECT value_id, variable_id, sourcetimestamp, value_double FROM (SELECT *, row_number() OVER (PARTITION BY variable_id ORDER BY sourcetimestamp DESC, value_id DESC) AS nth FROM {VARS}) WHERE nth <= 10")
def retention_keep_newest_n(spark, d):
    return retention.keep_newest(src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id", 10)


@query("effective_retention", "SELECT c_custkey AS variable_id, CASE WHEN c_custkey % 3 = 0 THEN 3600 ELSE least(c_custkey * 10, 3600) END AS seconds FROM customer")
def effective_retention(spark, d):
    asked = F.when(F.col("variable_id") % 3 == 0, None).otherwise(F.col("variable_id") * 10)
    return src.variable_metadata(spark, d).select("variable_id", retention.effective(asked, F.lit(3600)).cast("long").alias("seconds"))


@query("cleanup_selected_ids", f"SELECT * FROM {VARS} WHERE NOT (sourcetimestamp < TIMESTAMP '2024-01-20' AND variable_id IN (1, 2, 3))")
def cleanup_selected_ids(spark, d):
    return retention.cleanup(src.variables(spark, d), "sourcetimestamp", "2024-01-20", "variable_id", [1, 2, 3])


@query("conditional_delete", f"SELECT * FROM {VARS} WHERE NOT (value_double > 100 AND variable_id < 50)")
def conditional_delete(spark, d):
    return retention.delete_where(src.variables(spark, d), F.expr("value_double > 100 and variable_id < 50"))


@query("node_id_format", "SELECT n_nationkey, 'ns=2;s=' || n_name AS node_id FROM nation")
def node_id_format(spark, d):
    return src.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("ns=2;s="), "n_name").alias("node_id"))


@query("slug", "SELECT p_partkey, left(CASE WHEN s ~ '^[0-9].*' THEN 't_' || s ELSE s END, 48) AS slug FROM (SELECT p_partkey, lower(trim(regexp_replace('2_' || p_name || '.' || p_type, '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS s FROM part)")
def slug(spark, d):
    return src.table(spark, d, "part").select("p_partkey", node_ids.slug_column(F.lit("2"), F.concat_ws(".", "p_name", "p_type")).alias("slug"))


@query("bucket_any_width", "SELECT o_orderkey, time_bucket(INTERVAL '90 minutes', o_orderdate) AS bucket FROM orders")
def bucket_any_width(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", time_bucket(F.col("o_orderdate"), 90 * 60_000_000).alias("bucket"))


@query("table_counts", "SELECT * FROM (SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders)")
def table_counts(spark, d):
    return retention.table_counts({n: src.table(spark, d, n) for n in ("events", "orders", "customer")})


# streams, run to their end; the same results as in batch
@query("stream_rollup", _HOURLY)
def stream_rollup(spark, d):
    return jobs.last_state(jobs.hourly_rollup(jobs.stream(spark, f"{d}/events.parquet")))


@query("stream_latest", SQL["latest_per_series"])
def stream_latest(spark, d):
    return jobs.last_state(jobs.latest_values(jobs.stream(spark, f"{d}/events.parquet")))


@query("stream_dedup", SQL["dedup_first_write"])
def stream_dedup(spark, d):
    rows = jobs.stream(spark, f"{d}/orders.parquet")
    named = rows.select(F.col("o_custkey").alias("variable_id"), F.col("o_orderdate").alias("sourcetimestamp"), F.col("o_totalprice").alias("value_double"), F.col("o_orderkey").alias("arrival_seq"))
    return jobs.deduplicated(spark, named, ["variable_id", "sourcetimestamp"], "arrival_seq", "sourcetimestamp", "month")


# late rows are told by the watermark of the batch before the last, so there are three files
_FILES = ("event_id % 10 >= 2", "event_id % 10 = 1", "event_id % 10 = 0")


@query("stream_late_rows", f"""
    WITH rows AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS bucket FROM events),
    marks AS (SELECT max(ts) FILTER ({_FILES[0]}) - INTERVAL '3 hours' AS first, max(ts) - INTERVAL '3 hours' AS last FROM rows)
    SELECT bucket, user_id AS source_id, event_type, count(*) AS event_count FROM rows, marks
    WHERE bucket + INTERVAL '1 hour' <= last AND (NOT {_FILES[2]} OR bucket + INTERVAL '1 hour' > first) GROUP BY 1, 2, 3""")
def stream_late_rows(spark, d):
    """A tenth of the rows comes in the last file, behind the watermark for the most part: those are dropped."""
    path = f"{src.work_dir(spark)}/late-{uuid4().hex}"
    rows = src.table(spark, d, "events")
    for condition in _FILES:
        # small row groups deal a file to many tasks; one group would be one task, with all its windows in memory
        rows.where(condition).coalesce(1).write.mode("append").option("parquet.block.size", 4 << 20).parquet(path)
    return jobs.closed_rows(jobs.hourly_rollup(jobs.stream(spark, path, files_a_batch=1)))


def _house(spark) -> Warehouse:
    return Warehouse(spark, f"{src.work_dir(spark)}/house-{uuid4().hex}")


# writing: the warehouse's tables
def _ingested(spark, d) -> tuple[Table, Table]:
    """The orders as values, in micro-batches, ended half-way and started again: history and last values."""
    at = _house(spark).path
    path, checkpoint = f"{at}/in", f"{at}/checkpoint"
    tables = Table(spark, f"{at}/variables", "sourcetimestamp", "month"), Table(spark, f"{at}/last_values")
    rows = src.variables_dup(spark, d)
    for turn in range(2):
        rows.where(F.col("arrival_seq") % 2 == turn).repartition(2, "variable_id").write.mode("append").parquet(path)
        jobs.ingest(jobs.stream(spark, path, files_a_batch=1), *tables, checkpoint).awaitTermination()
    return tables


@query("stream_ingest", f"SELECT variable_id, sourcetimestamp, count(*) OVER (PARTITION BY variable_id) AS n FROM (SELECT DISTINCT variable_id, sourcetimestamp FROM {DUP})")
def stream_ingest(spark, d):
    from pyspark.sql import Window

    rows = _ingested(spark, d)[0].read()
    return rows.select("variable_id", "sourcetimestamp", F.count("*").over(Window.partitionBy("variable_id")).alias("n"))


@query("stream_ingest_last_values", f"SELECT variable_id, max(sourcetimestamp) AS sourcetimestamp, false AS is_seed FROM {DUP} GROUP BY 1")
def stream_ingest_last_values(spark, d):
    return writes.last_values(_ingested(spark, d)[1]).select("variable_id", "sourcetimestamp", "is_seed")


_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS nth FROM events) WHERE nth = 1)"
_TYPED_FIELDS = {"error": ["k"], "signup": ["k"]}


def _events_in(spark, d):
    return src.table(spark, d, "events").select("event_id", F.col("user_id").alias("source_id"), "event_type", F.col("ts").alias("event_timestamp"), "props")


def _by_day(spark, d):
    """Events at midnight of their days, so that many of a source are at one instant and only the first of them counts."""
    return _events_in(spark, d).withColumn("event_timestamp", F.date_trunc("day", "event_timestamp"))


def _saved(spark, d, mode: str | None, rows: DataFrame | None = None) -> Warehouse:
    """Events in three overlapping batches, the second one twice."""
    house, rows = _house(spark), _events_in(spark, d) if rows is None else rows
    for number, part in enumerate(("event_id % 3 = 0", "event_id % 3 <= 1", "event_id >= 0")):
        for _ in range(2 if number == 1 else 1):
            writes.save_events(house, rows.where(part), _TYPED_FIELDS, mode, number=number)
    return house


# the order of batches decides which of two events at one instant was first
_WON = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id % 3, event_id) AS nth FROM events) WHERE nth = 1)"


@query("dual_write", f"SELECT a.event_id, a.event_type, a.event_id AS legacy_row_id, t.k FROM {_WON} a LEFT JOIN (SELECT event_id, props->>'$.k' AS k FROM {_WON} WHERE event_type IN ('error', 'signup')) t USING (event_id)")
def dual_write(spark, d):
    house = _saved(spark, d, "dual")
    tables = reads.union_types([house.table(f"evt_{t}").read().select("event_id", "k") for t in _TYPED_FIELDS])
    both = writes.anchors(house).join(house.table("events").read().select("event_id"), "event_id")
    return both.join(tables, "event_id", "left").select("event_id", "event_type", "legacy_row_id", "k")


@query("write_v2_only", f"SELECT event_id, event_type, CAST(NULL AS BIGINT) AS legacy_row_id, props FROM {_WON}")
def write_v2_only(spark, d):
    """Without legacy rows the payload of every event is kept, of those whose type has no table as well."""
    house = _saved(spark, d, "v2")
    return writes.anchors(house).join(writes.payloads(house), writes.ANCHOR_KEYS).select("event_id", "event_type", "legacy_row_id", "props")


_DAYS = _WON.replace("user_id, ts ORDER", "user_id, date_trunc('day', ts) ORDER")
_HELD = f"SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS event_timestamp, event_type, props->>'$.k' AS k FROM {_DAYS} WHERE event_type IN ('error', 'signup')"


def _typed_rows(house):
    return reads.union_types([house.table(f"evt_{t}").read().withColumn("event_type", F.lit(t)) for t in _TYPED_FIELDS]).select("event_id", "event_timestamp", "event_type", "k")


@query("dual_typed_rows", _HELD)
def dual_typed_rows(spark, d):
    """All that the typed tables hold: no event is there that lost against another at its source and instant."""
    return _typed_rows(_saved(spark, d, "dual", _by_day(spark, d)))


@query("v2_typed_rows", _HELD)
def v2_typed_rows(spark, d):
    return _typed_rows(_saved(spark, d, "v2", _by_day(spark, d)))


@query("dual_after_v2", "SELECT event_type, count(*) AS orphans, 0 AS n FROM events WHERE false GROUP BY 1 UNION ALL SELECT 'error', 0, (SELECT count(*) FROM " + _DAYS + " WHERE event_type = 'error') UNION ALL SELECT 'signup', 0, (SELECT count(*) FROM " + _DAYS + " WHERE event_type = 'signup')")
def dual_after_v2(spark, d):
    """A warehouse that is switched from v2 to dual while events come twice: typed rows without their event, and typed rows."""
    house, rows = _house(spark), _by_day(spark, d)
    writes.save_events(house, rows.where("event_id % 3 = 0"), _TYPED_FIELDS, "v2", number=0)
    for number, part in enumerate(("event_id % 3 <= 1", "event_id >= 0"), 1):
        writes.save_events(house, rows.where(part), _TYPED_FIELDS, "dual", number=number)
    counts = _typed_rows(house).groupBy("event_type").agg(F.count("*").alias("n"))
    return writes.orphans(house, list(_TYPED_FIELDS)).join(counts, "event_type").select("event_type", "orphans", "n")


@query("anchor_filled_in", f"SELECT event_id, event_id AS legacy_row_id FROM {_DAYS}")
def anchor_filled_in(spark, d):
    """Anchors of v2 get their legacy row when the events come again in dual mode."""
    house, rows = _house(spark), _by_day(spark, d)
    writes.save_events(house, rows.where("event_id % 3 = 0"), _TYPED_FIELDS, "v2", number=0)
    for number, part in enumerate(("event_id % 3 <= 1", "event_id >= 0"), 1):
        writes.save_events(house, rows.where(part), _TYPED_FIELDS, "dual", number=number)
    return writes.anchors(house).select("event_id", "legacy_row_id")


@query("insert_events_first_write", f"SELECT event_id, user_id AS source_id, ts AS event_timestamp FROM {_FIRST}")
def insert_events_first_write(spark, d):
    return ingest.insert_new(None, _events_in(spark, d), writes.EVENT_KEYS, "event_id").select("event_id", "source_id", "event_timestamp")


@query("anchor_upsert", "SELECT event_id, ts AS event_timestamp, CASE WHEN event_id % 4 = 0 THEN -event_id ELSE event_id END AS legacy_row_id FROM events WHERE event_id % 5 <> 0 OR event_id % 2 = 0")
def anchor_upsert(spark, d):
    rows = _events_in(spark, d).select("event_id", "event_timestamp", F.col("event_id").alias("legacy_row_id"))
    kept_id = F.when(F.col("event_id") % 4 == 0, -F.col("event_id"))
    return writes.merge_anchors(rows.where("event_id % 2 = 0").withColumn("legacy_row_id", kept_id), rows.where("event_id % 5 <> 0 or event_id % 2 = 0"))


@query("typed_insert", "SELECT event_id, ts AS event_timestamp, user_id AS source_id, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE props->>'$.k' END AS k FROM events WHERE event_type = 'error'")
def typed_insert(spark, d):
    rows = writes.typed_rows(_events_in(spark, d), "error", ["k"])
    return writes.typed_insert(rows.where("event_id % 2 = 0").withColumn("k", F.lit("old")), rows)


# typed reads: one type, several, a page behind a cursor
def _typed(spark, d):
    return {t: src.typed_events(spark, d, t) for t in ("click", "error", "signup")}


@query("typed_read_page", f"SELECT event_id, ts AS event_timestamp, event_type, props->>'$.k' AS k, value FROM events WHERE event_type = 'error' AND {BETWEEN} AND value > 20 ORDER BY ts, event_id LIMIT 40")
def typed_read_page(spark, d):
    spec = [element("GreaterThan", attribute("value"), literal(20))]
    return typed.read_typed(src.event_anchor(spark, d), _typed(spark, d), ["error"], _bounds(count=40), spec).select("event_id", "event_timestamp", "event_type", "k", "value")


@query("typed_read_union_page", f"SELECT event_id, ts AS event_timestamp, event_type, props->>'$.k' AS k, value FROM events WHERE event_type IN ('error', 'signup') AND ts <= TIMESTAMP '2024-01-25' AND (ts < TIMESTAMP '{_CUT}' OR (ts = TIMESTAMP '{_CUT}' AND event_id < 9)) AND (props->>'$.k') ILIKE '%1%' ORDER BY ts DESC, event_id DESC LIMIT 30")
def typed_read_union_page(spark, d):
    spec = [element("ILike", attribute("k"), literal("*1*"))]
    page = typed.read_typed(src.event_anchor(spark, d), _typed(spark, d), ["error", "signup", "no_such"], _bounds(None, END, 30), spec, cursor=(_CUT, 9))
    return page.select("event_id", "event_timestamp", "event_type", "k", "value")


@query("typed_read_all_types", f"SELECT event_id, event_type, props->>'$.k' AS k FROM events WHERE event_type IN ('click', 'error', 'signup') AND user_id = 5 AND {BETWEEN}")
def typed_read_all_types(spark, d):
    return typed.read_typed(src.event_anchor(spark, d), _typed(spark, d), None, _bounds(), source=5).select("event_id", "event_type", "k")


# filter plans
_PLANNED = [
    element("InList", attribute("EventType"), literal("ns=2;s=Events.error"), literal("view")), element("ILike", attribute("props", "key"), literal("*1?")),
    element("IsNull", attribute("k")), element("Or", ref(1), ref(2)), element("GreaterThan", attribute("value"), literal(5)), element("And", ref(0), ref(3), ref(4)),
]


@query("filter_plan", "SELECT event_id, props->>'$.k' AS k FROM events WHERE event_type IN ('error', 'view') AND ((props->>'$.k') ILIKE '%1_' OR (props->>'$.k') IS NULL)")
def filter_plan(spark, d):
    """The part of a filter that the plan may ask early: its types, then the rest; the comparison with value is left to the whole filter."""
    plan = planner.build(_PLANNED, aliases={"key": "k"}, allowed={"k"})
    rows = src.table(spark, d, "events").select("event_id", "event_type", payload.field(F.col("props"), "k").alias("k"))
    _, names = plan.types()
    return rows.where(F.col("event_type").isin(names) & plan.without_types().column(rows.schema)).select("event_id", "k")


_K_FITS = "((props->>'$.k') ILIKE '%1_' OR (props->>'$.k') IS NULL)"
_TYPES_SHOWN, _K_SHOWN = "EventType InList ''ns=2;s=Events.error'' ''view''", "(k ILike ''*1?'' or k IsNull)"


@query("filter_plan_shown", f"SELECT 'whole' AS part, count_if(event_type = 'view' AND {_K_FITS}) AS n, '({_TYPES_SHOWN} and {_K_SHOWN})' AS plan FROM events UNION ALL SELECT 'without_types', count_if({_K_FITS}), '{_K_SHOWN}' FROM events UNION ALL SELECT 'other_fields', count_if(event_type = 'view'), '{_TYPES_SHOWN}' FROM events")
def filter_plan_shown(spark, d):
    """Parts of a plan as text, and how many events pass each."""
    plan = planner.build(_PLANNED, aliases={"key": "k"}, allowed={"k"})
    rows = src.table(spark, d, "events").select("event_type", payload.field(F.col("props"), "k").alias("k"))
    parts = {"whole": plan, "without_types": plan.without_types(), "other_fields": plan.restricted({"serial"})}
    counts = rows.agg(*[F.count_if(p.column(rows.schema, {"EventType": "event_type"})).alias(n) for n, p in parts.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("n"), F.lit(p.shown()).alias("plan")) for n, p in parts.items()])))


@query("event_explain", "SELECT true AS pushed, true AS pruned, true AS top_k")
def event_explain(spark, d):
    """What the plan of the flagship says: conditions at the scan, only its columns read, no full sort."""
    text = reads.plan_text(flagship(spark, d))
    flat = text.replace("\n", " ")
    return spark.createDataFrame([("GreaterThan(value,5.0)" in flat and "EqualTo(user_id,5)" in flat, "props" not in flat, "TakeOrderedAndProject" in flat)], "pushed boolean, pruned boolean, top_k boolean")


@query("select_clauses", "SELECT value, event_id, CAST(NULL AS VARCHAR) AS serial FROM events")
def select_clauses(spark, d):
    return reads.selected(src.table(spark, d, "events"), [["value"], "event_id", ["Body", "serial"], "value"])


@query("filter_stripped_of_types", "SELECT event_id FROM events WHERE value > 100 AND NOT (event_type = 'view')")
def filter_stripped_of_types(spark, d):
    """Conditions on types go beneath And alone; the one beneath Not stays."""
    from .plans.filters import strip_types

    spec = [*type_filter(["error"]), element("GreaterThan", _V, literal(100)), element("Equals", _T, literal("view")), element("Not", ref(2)), element("And", ref(0), ref(1), ref(3))]
    rows = src.table(spark, d, "events")
    return rows.where(compile_filter(strip_types(spec), rows.schema)).select("event_id")


@query("filter_bad_pattern_is_false", "SELECT event_id FROM events WHERE value > 300")
def filter_bad_pattern_is_false(spark, d):
    """A pattern that is no text makes its whole filter false; another filter beside it is not touched."""
    rows = src.table(spark, d, "events")
    bad = compile_filter([element("Like", _T, literal(5)), element("GreaterThan", _V, literal(0)), element("Or", ref(0), ref(1))], rows.schema)
    return rows.where(bad | compile_filter([element("GreaterThan", _V, literal(300))], rows.schema)).select("event_id")


@query("filter_emitting_node", "SELECT event_id FROM events WHERE user_id = 5")
def filter_emitting_node(spark, d):
    rows = src.event_anchor(spark, d)
    return rows.where(compile_filter([element("Equals", {"attribute": [], "of": "NodeId"}, literal(5))], rows.schema)).select("event_id")


# latest values by level
_LEVELS = "SELECT c_custkey AS variable_id, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-02' ELSE h.t END AS sourcetimestamp, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE h.v END AS value_double, CASE WHEN c_custkey % 3 = 0 THEN 'stored' WHEN h.t IS NOT NULL THEN 'history' ELSE 'none' END AS level FROM customer LEFT JOIN (SELECT user_id, max(ts) AS t, arg_max(value, (ts, event_id)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) h ON user_id = c_custkey"


def _stored(spark, d):
    return src.variable_metadata(spark, d).where("variable_id % 3 = 0").select("variable_id", reads.ntz("2024-01-02").alias("sourcetimestamp"), F.lit(1.0).alias("value_double"))


def _levels(spark, d):
    return reads.latest_levels(src.variable_metadata(spark, d), _stored(spark, d), src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id", "value_double", since="2024-01-20")


@query("latest_levels", _LEVELS)
def latest_levels(spark, d):
    return _levels(spark, d)


@query("latest_stored_only", "SELECT c_custkey AS variable_id, CASE WHEN c_custkey % 3 = 0 THEN 1.0 END AS value_double FROM customer")
def latest_stored_only(spark, d):
    rows = reads.latest_levels(src.variable_metadata(spark, d), _stored(spark, d), src.variables(spark, d), "variable_id", "sourcetimestamp", "value_id", "value_double", fallback=False)
    return rows.select("variable_id", "value_double")


@query("latest_single_node", "SELECT user_id AS variable_id, max(ts) AS sourcetimestamp, arg_max(value, (ts, event_id)) AS value_double, 'history' AS level FROM events WHERE user_id = 5 GROUP BY 1")
def latest_single_node(spark, d):
    rows = src.variables(spark, d).where("variable_id = 5")
    return reads.latest_levels(spark.createDataFrame([(5,)], "variable_id long"), None, rows, "variable_id", "sourcetimestamp", "value_id", "value_double")


@query("latest_write_back", f"SELECT variable_id, sourcetimestamp, value_double FROM ({_LEVELS}) WHERE level <> 'none'")
def latest_write_back(spark, d):
    return reads.healed(_stored(spark, d), _levels(spark, d), "variable_id", "sourcetimestamp", "value_double")


@query("cache_levels", f"SELECT level, count(*) AS series FROM ({_LEVELS}) GROUP BY 1")
def cache_levels(spark, d):
    return observe.cache_levels(_levels(spark, d))


# backfill in batches
@query("backfill_batch", "SELECT event_id FROM events WHERE event_id > 100 AND event_type = 'view' ORDER BY event_id LIMIT 40")
def backfill_batch(spark, d):
    e = src.table(spark, d, "events").select("event_id")
    return backfill.next_batch(e, src.event_anchor(spark, d).where("event_type <> 'view'"), 100, 40)


@query("backfill_progress", "SELECT max(event_id) AS cursor, count(*) AS rows, any_value(lag) AS lag, any_value(total) AS total, any_value(pct) AS coverage_pct FROM (SELECT event_id FROM events WHERE event_id > 100 AND event_type = 'view' ORDER BY event_id LIMIT 40), (SELECT count(*) FILTER (event_type = 'view') AS lag, count(*) AS total, round(100.0 * count(*) FILTER (event_type <> 'view') / count(*), 2) AS pct FROM events)")
def backfill_progress(spark, d):
    return backfill.progress(src.table(spark, d, "events"), src.event_anchor(spark, d).where("event_type <> 'view'"), 100, 40)


@query("backfill_typed", "SELECT event_id, ts AS event_timestamp, user_id AS source_id, props->>'$.k' AS k FROM events WHERE event_type = 'error' AND event_id % 3 <> 0")
def backfill_typed(spark, d):
    rows = _events_in(spark, d)
    storage = spark.createDataFrame([("error", "evt_error"), ("view", None)], "event_type string, table_name string")
    held = writes.typed_rows(rows.where("event_id % 3 = 0"), "error", ["k"])
    return backfill.missing_typed(rows, storage, held, rows, "error", ["k"])


@query("backfill_run", "SELECT event_id, event_id AS legacy_row_id FROM events")
def backfill_run(spark, d):
    house, rows = _house(spark), _events_in(spark, d)
    house.table("events").append(rows)
    house.table("event_anchor").append(rows.where("event_id % 2 = 0").select("event_id", "event_timestamp", "source_id", "event_type", F.col("event_id").alias("legacy_row_id")))
    backfill.run(house, rows.count() // 3 + 1)
    return house.table("event_anchor").read().select("event_id", "legacy_row_id")


@query("type_storage_join", "SELECT event_type_name, 'evt_' || event_type AS table_name FROM (SELECT DISTINCT event_type, 'ns=2;s=Events.' || event_type AS event_type_name FROM events) WHERE event_type IN ('error', 'signup')")
def type_storage_join(spark, d):
    storage = spark.createDataFrame([(t, node_ids.event_table(t)) for t in _TYPED_FIELDS], "event_type string, table_name string")
    types = src.event_types(spark, d).withColumn("event_type", F.substring_index("event_type_name", ".", -1))
    return types.join(storage, "event_type").select("event_type_name", "table_name")


# registry
@query("storage_sync", "SELECT event_type, CASE WHEN max(value) > 300 THEN 'evt_new_' ELSE 'evt_' END || event_type AS table_name FROM events GROUP BY 1")
def storage_sync(spark, d):
    """Tables of types, with those of some types renamed and no others touched."""
    tops = src.table(spark, d, "events").groupBy("event_type").agg(F.max("value").alias("top"))
    held = tops.select("event_type", F.concat(F.lit("evt_"), "event_type").alias("table_name"))
    moved = tops.where("top > 300").select("event_type", F.concat(F.lit("evt_new_"), "event_type").alias("table_name"))
    return registry.upsert(held, moved, ["event_type"])


@query("register_sources", "SELECT n_name AS name, n_nationkey + 1 AS source_id, CASE WHEN n_nationkey < 5 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM nation UNION ALL SELECT 'new ' || r_name, (SELECT max(n_nationkey) + 1 FROM nation) + row_number() OVER (ORDER BY r_regionkey), TIMESTAMP '2024-02-01' FROM region")
def register_sources(spark, d):
    n, r = src.table(spark, d, "nation"), src.table(spark, d, "region")
    held = n.select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("long").alias("source_id"), reads.ntz("2024-01-01").alias("updated_at"))
    asked = n.where("n_nationkey < 5").select(F.col("n_name").alias("name"), F.lit(-1).alias("position")).unionByName(r.select(F.concat(F.lit("new "), "r_name").alias("name"), F.col("r_regionkey").cast("int").alias("position")))
    return ingest.touch(held, asked, "name", "source_id", reads.ntz("2024-02-01")).select("name", F.col("source_id").cast("long").alias("source_id"), "updated_at")


@query("array_parameters", "SELECT p.id, p.name, count(event_id) AS events FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL), (-1, NULL)) AS p(id, name) LEFT JOIN events ON user_id = p.id GROUP BY 1, 2")
def array_parameters(spark, d):
    """Parallel arrays of parameters as rows that the events are joined to."""
    asked = reads.array_rows(spark, id=[1, 2, 3, -1], name=["a", "b"]).select(F.col("id").cast("int").alias("id"), "name")
    counts = src.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return asked.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("events"))


@query("json_safe", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"raw\":\"' || base64(encode(n_name)) || '\"}' AS body FROM nation")
def json_safe(spark, d):
    return src.table(spark, d, "nation").select("n_nationkey", payload.json_safe(F.col("n_name").alias("name"), F.col("n_name").cast("binary").alias("raw")).alias("body"))


# care of tables
def _stored_values(spark, d) -> Table:
    table = _house(spark).table("variables")
    for turn in range(2):
        table.append(src.variables(spark, d).where(F.col("value_id") % 2 == turn))
    return table


@query("retention_drop_days", f"SELECT * FROM {VARS} WHERE sourcetimestamp >= TIMESTAMP '2024-01-20'")
def retention_drop_days(spark, d):
    table = _stored_values(spark, d)
    table.retain(12, datetime(2024, 2, 1, 10))
    return table.read()


@query("compacted_table", f"SELECT * FROM {VARS} WHERE sourcetimestamp >= TIMESTAMP '2024-01-10' AND sourcetimestamp < TIMESTAMP '2024-01-13'")
def compacted_table(spark, d):
    table = _stored_values(spark, d)
    table.compact()
    return table.read(date(2024, 1, 10), date(2024, 1, 12))


@query("clear_all", "SELECT 0 AS row_count, 4 AS columns")
def clear_all(spark, d):
    table = _stored_values(spark, d)
    table.clear()
    return table.read().agg(F.count("*").cast("int").alias("row_count")).withColumn("columns", F.lit(len(table.read().columns)))


@query("soft_delete", "SELECT c_custkey AS variable_id, c_custkey NOT IN (1, 2, 3) AS is_active FROM customer")
def soft_delete(spark, d):
    return retention.deactivate(src.variable_metadata(spark, d), "variable_id", [1, 2, 3]).select("variable_id", "is_active")


@query("warehouse_info", "SELECT 'events' AS table_name, count(*) AS row_count, 1 AS version FROM events UNION ALL SELECT 'variables', count(*), 2 FROM events")
def warehouse_info(spark, d):
    house = _house(spark)
    house.table("events").append(_events_in(spark, d))
    for turn in range(2):
        house.table("variables").append(src.variables(spark, d).where(F.col("value_id") % 2 == turn))
    return house.stats().select("table_name", "row_count", "version")


@query("day_files", "SELECT CAST(ts AS DATE) AS day, count(*) AS row_count, CAST(count(DISTINCT event_id % 2) AS BIGINT) AS files FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def day_files(spark, d):
    """Rows and files of the newest days, from the footers."""
    table = _house(spark).table("variables")
    for turn in range(2):
        table.append(src.variables(spark, d).where(F.col("value_id") % 2 == turn).coalesce(1))
    return table.stats("day").orderBy(F.desc("day")).limit(20).select("day", "row_count", "files")


@query("retention_policy", f"SELECT * FROM {VARS} WHERE sourcetimestamp >= TIMESTAMP '2024-01-22'")
def retention_policy(spark, d):
    """A period that the table keeps, put in place of another and applied at once."""
    house = _house(spark)
    table = house.table("variables")
    table.append(src.variables(spark, d))
    table.set_policy(300)
    house.table("variables").set_policy(10, datetime(2024, 2, 1, 10))
    return house.table("variables").read()


@query("timing_stats", "SELECT o_custkey AS k, count(*) AS count, CAST(sum(c) AS BIGINT) AS total, arg_max(c, o_orderkey) AS last, max(c) AS max, avg(c) AS avg FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY 1")
def timing_stats(spark, d):
    rows = src.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), "o_orderkey")
    return observe.timing(rows, "k", "c", "o_orderkey")


# builders, operands and pages that the queries above do not reach
@query("filter_source_builder", "SELECT event_id FROM events WHERE user_id = 7")
def filter_source_builder(spark, d):
    rows = src.event_anchor(spark, d)
    return rows.where(compile_filter(filters.source_filter(7), rows.schema)).select("event_id")


@query("filter_property_builder", "SELECT event_id FROM events WHERE value > 12.5 AND (props->>'$.k') = '3'")
def filter_property_builder(spark, d):
    rows = src.table(spark, d, "events").select("event_id", "value", payload.field(F.col("props"), "k").alias("k"))
    both = [filters.property_filter("value", "GreaterThan", "12.5"), filters.property_filter("k", "Equals", "3")]
    return rows.where(compile_filter(both[0], rows.schema) & compile_filter(both[1], rows.schema)).select("event_id")


@query("filter_unknown_operand", "SELECT event_id FROM events WHERE value < 5")
def filter_unknown_operand(spark, d):
    """An operand of a kind that is not known is null; a comparison with null is false, and its negation true."""
    rows = src.table(spark, d, "events")
    spec = [element("Equals", {"browse_path": ["a"]}, literal(1)), element("Not", ref(0)), element("LessThan", _V, literal(5)), element("And", ref(1), ref(2))]
    return rows.where(compile_filter(spec, rows.schema)).select("event_id")


@query("filter_text_of_values", "SELECT event_id FROM events WHERE CAST(value * 1e8 AS VARCHAR) > '5' AND CAST(value / 1e8 AS VARCHAR) LIKE '%e-0%' AND (CASE WHEN value > 50 THEN 'True' ELSE 'False' END) = 'False'")
def filter_text_of_values(spark, d):
    """Numbers and booleans beside texts compare by their own text."""
    rows = src.table(spark, d, "events").select("event_id", (F.col("value") * 1e8).alias("large"), (F.col("value") / 1e8).alias("small"), (F.col("value") > 50).alias("high"))
    spec = [element("GreaterThan", attribute("large"), literal("5")), element("Equals", attribute("high"), literal("False")), element("And", ref(0), ref(1))]
    text = payload.text_of(F.col("small"), rows.schema["small"].dataType)
    return rows.where(compile_filter(spec, rows.schema) & text.contains("e-0")).select("event_id")


@query("filter_shared_element", "SELECT 'shared' AS form, count(*) AS n FROM events WHERE value > 100 UNION ALL SELECT 'strict', 0")
def filter_shared_element(spark, d):
    """An element that is reached twice: as it reads, and by the rule that it counts as false the second time."""
    rows = src.table(spark, d, "events")
    spec = [element("GreaterThan", _V, literal(100)), element("And", ref(0), ref(0))]
    count = lambda form, strict: rows.where(compile_filter(spec, rows.schema, strict_shared=strict)).agg(F.lit(form).alias("form"), F.count("*").alias("n"))
    return count("shared", False).unionByName(count("strict", True))


@query("continued_pages", f"SELECT event_id, event_timestamp FROM {ANCHOR} WHERE source_id = 7 AND event_timestamp <= TIMESTAMP '2024-02-02' ORDER BY event_timestamp DESC, event_id DESC LIMIT 9")
def continued_pages(spark, d):
    """Three pages, each from the cursor that the one before left."""
    cursor, pages, b = None, [], _bounds(None, None, 3)
    for _ in range(3):
        pages.append(reads.read_events(src.event_anchor(spark, d), 7, b, cursor=cursor).select("event_id", "event_timestamp"))
        cursor = reads.continuation(pages[-1].collect(), b.limit)
        if cursor is None:
            break
    return reads.union_types(pages)


@query("flat_settings", "SELECT event_type, count(*) AS \"figures.count\", min(value) AS \"figures.value.min\", max(value) AS \"figures.value.max\" FROM events GROUP BY 1")
def flat_settings(spark, d):
    """Nested figures as flat columns with dots."""
    nested = F.struct(F.count("*").alias("count"), F.struct(F.min("value").alias("min"), F.max("value").alias("max")).alias("value"))
    rows = src.table(spark, d, "events").groupBy("event_type").agg(nested.alias("figures"))
    return rows.select(*[c.alias(n) for n, c in node_ids.flat_columns(rows.schema).items()])


@query("storage_modes", "SELECT CASE event_type WHEN 'click' THEN 'v2' WHEN 'view' THEN 'legacy' ELSE 'dual' END AS mode, count(*) AS events FROM events GROUP BY 1")
def storage_modes(spark, d):
    """Modes as they may be written down, one a type of event."""
    named = F.when(F.col("event_type") == "click", " V2 ").when(F.col("event_type") == "view", "Legacy").when(F.col("event_type") == "error", "other")
    return src.table(spark, d, "events").groupBy(ingest.storage_mode_column(named).alias("mode")).agg(F.count("*").alias("events"))


@query("table_probe", "SELECT 'events' AS table_name, true AS found, 6 AS columns UNION ALL SELECT 'no_such', false, 0")
def table_probe(spark, d):
    found = {n: probe(spark, f"{d}/{n}.parquet") for n in ("events", "no_such")}
    return spark.createDataFrame([(n, x["exists"], len(x["columns"])) for n, x in found.items()], "table_name string, found boolean, columns int")


@query("valid_events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '2024-02-01' END AS event_timestamp FROM events WHERE event_type <> 'view'")
def valid_events(spark, d):
    """Events without a type are dropped; one without a time gets now."""
    rows = src.table(spark, d, "events").select("event_id", F.col("user_id").alias("source_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("Time"))
    return ingest.valid_events(rows, reads.ntz("2024-02-01")).select("event_id", "event_timestamp")


@query("register_one_node", "SELECT 'ns=2;i=' || c_custkey AS node_id, CASE WHEN c_custkey = 3 THEN 'Unknown' ELSE 'Double' END AS data_type FROM customer")
def register_one_node(spark, d):
    """Registering one known node again resets its type."""
    return ingest.register(src.variable_metadata(spark, d), spark.createDataFrame([("ns=2;i=3", 0)], "node_id string, position int"), reset_type=True).select("node_id", "data_type")


# typed backfill, restore, refresh, state
@query("backfill_typed_run", "SELECT event_id, ts AS event_timestamp, event_type, props->>'$.k' AS k FROM events WHERE event_type IN ('error', 'signup')")
def backfill_typed_run(spark, d):
    """All types in one pass, in batches; some rows are there before, one table has a batch that the other lacks."""
    house, rows = _house(spark), _events_in(spark, d)
    house.table("events").append(rows)
    house.table("event_anchor").append(rows.select("event_id", "event_timestamp", "source_id", "event_type", F.col("event_id").alias("legacy_row_id")))
    for t in _TYPED_FIELDS:
        house.table(f"evt_{t}").append(writes.typed_rows(rows.where("event_id % 3 = 0"), t, ["k"]))
    size = rows.where(F.col("event_type").isin(list(_TYPED_FIELDS))).count() // 4 + 1
    missing = backfill.missing_of_types(house, _TYPED_FIELDS, -1)
    end = next(iter(backfill.batch_ends(missing, size)), None)
    first = missing.where(F.col("event_id") <= end)
    part = writes.typed_rows(first.join(writes.payloads(house).hint("merge"), writes.ANCHOR_KEYS), "error", ["k"])
    house.table("evt_error").append_new(part, writes.ANCHOR_KEYS, "event_id", "typed_backfill", end)
    backfill.run_typed(house, _TYPED_FIELDS, size)
    return _typed_rows(house)


def _restored(spark, d):
    house = _house(spark)
    last = house.table("last_values")
    writes.seed_values(last, _seeds(spark, d))
    figures = backfill.restore(last, src.variables(spark, d), 4, staged=lambda rows: src.stored(rows, "restored"))
    return last, figures


@query("restore_statistics", "SELECT c_custkey % 4 AS chunk, count(*) FILTER (c_custkey IN (SELECT user_id FROM events)) AS found, count(*) FILTER (c_custkey NOT IN (SELECT user_id FROM events)) AS missing, count(*) AS cleared FROM customer GROUP BY 1")
def restore_statistics(spark, d):
    """Figures of each chunk, counted while it is written."""
    return spark.createDataFrame([(x["chunk"], x["found"], x["missing"], x["cleared"]) for x in _restored(spark, d)[1]], "chunk long, found long, missing long, cleared long")


@query("restored_values", SQL["backfill_seeds"].replace(", max(ts) IS NOT NULL AS restored", ""))
def restored_values(spark, d):
    return writes.last_values(_restored(spark, d)[0])


@query("seeds_counted", "SELECT count(*) FILTER (c_custkey % 3 = 0) AS first, count(*) FILTER (c_custkey % 3 <> 0) AS second, 0 AS third FROM customer")
def seeds_counted(spark, d):
    """How many seeds each of three calls wrote; a series that has a row gets none."""
    last, seeds = _house(spark).table("last_values"), _seeds(spark, d)
    n = [writes.seed_values(last, rows) for rows in (seeds.where("variable_id % 3 = 0"), seeds, seeds)]
    return spark.createDataFrame([tuple(n)], "first long, second long, third int")


_ARRIVAL = "((day(ts) - 1) // 10 + CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 10 = 5 THEN 2 ELSE 0 END)"


@query("stream_rollup_refreshed", f"""
    WITH e AS (SELECT *, {_ARRIVAL} AS arrival, time_bucket(INTERVAL '1 hour', ts) AS bucket FROM events),
    w AS (SELECT b, (SELECT max(ts) FROM e WHERE arrival <= b) AS now FROM (SELECT DISTINCT arrival AS b FROM e)),
    r AS (SELECT bucket, max(b) AS last FROM (SELECT DISTINCT bucket FROM e), w WHERE bucket >= time_bucket(INTERVAL '1 hour', now - INTERVAL 12 DAY) AND bucket < time_bucket(INTERVAL '1 hour', now - INTERVAL 1 DAY) GROUP BY 1)
    SELECT bucket, user_id AS source_id, event_type, count(*) AS event_count FROM e JOIN r USING (bucket) WHERE arrival <= last GROUP BY 1, 2, 3""")
def stream_rollup_refreshed(spark, d):
    """A tenth of the events comes ten days late and a tenth twenty; hours are counted anew while the window of twelve days holds them."""
    house = _house(spark)
    rows = _events_in(spark, d).withColumn("arrival", F.expr(_ARRIVAL.replace("//", "div").replace("day(ts)", "day(event_timestamp)")))
    arrivals = [r[0] for r in rows.select("arrival").distinct().orderBy("arrival").collect()]  # six at most
    window = temporal.RefreshWindow(timedelta(days=12), timedelta(days=1))
    for arrival in arrivals:  # a restart for each
        rows.where(F.col("arrival") == arrival).drop("arrival").coalesce(16).write.mode("append").parquet(f"{house.path}/in")  # as many files as a batch takes
        jobs.refreshed_rollup(jobs.stream(spark, f"{house.path}/in"), house, f"{house.path}/checkpoint", window).awaitTermination()
    return temporal.refreshed(house.table("event_rollup"))


@query("stream_newest_state", "SELECT user_id AS variable_id, coalesce(max(ts) FILTER (event_id % 4 <> 0), max(ts)) AS sourcetimestamp, coalesce(arg_max(value, (ts, event_id)) FILTER (event_id % 4 <> 0), arg_max(value, (ts, event_id))) AS value_double, count(*) FILTER (event_id % 4 <> 0) = 0 AS is_seed FROM events GROUP BY 1")
def stream_newest_state(spark, d):
    """Last values kept as a stream's state over a restart; every fourth event is a seed, which any value beats."""
    at = _house(spark).path
    rows = src.variables(spark, d).withColumn("arrival_seq", F.col("value_id")).withColumn("is_seed", F.col("value_id") % 4 == 0)
    for turn in range(2):
        rows.where(F.col("value_id") % 2 == turn).coalesce(1).write.mode("append").parquet(f"{at}/in")
        jobs.newest_state(jobs.stream(spark, f"{at}/in"), f"{at}/checkpoint").awaitTermination()
    return jobs.state_of(spark, f"{at}/checkpoint")


@query("type_of_each_name", "SELECT 'error' AS name, event_type_id, event_type_name FROM (SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS event_type_id, 'ns=2;s=Events.' || event_type AS event_type_name FROM (SELECT DISTINCT event_type FROM events)) WHERE event_type_name = 'ns=2;s=Events.error' UNION ALL SELECT 'ns=2;s=Events.view', event_type_id, event_type_name FROM (SELECT CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS event_type_id, 'ns=2;s=Events.' || event_type AS event_type_name FROM (SELECT DISTINCT event_type FROM events)) WHERE event_type_name = 'ns=2;s=Events.view'")
def type_of_each_name(spark, d):
    """One type a name, also where another's name ends alike; a name without a type has no row."""
    types = src.event_types(spark, d)
    more = types.where("event_type_name like '%error'").select((F.col("event_type_id") + 100).alias("event_type_id"), F.lit("ns=9;s=error").alias("event_type_name"))
    return reads.resolve_each(types.unionByName(more), ["error", "ns=2;s=Events.view", "no_such"])
