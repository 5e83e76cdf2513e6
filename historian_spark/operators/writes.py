"""Writing: values and events into warehouse tables, once each, whatever is run again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.node_ids import event_table
from . import ingest

VALUE_KEYS = ["variable_id", "sourcetimestamp"]
EVENT_KEYS = ["source_id", "event_timestamp"]  # the type is no part of it: two types at one instant are one event
ANCHOR_KEYS = ["event_id", "event_timestamp"]


def save_values(history, last, batch: DataFrame, job: str = "values", number: int | None = None, arrival: str = "arrival_seq", value: str = "value_double") -> None:
    """A batch of values: history keeps the first of each key, last gets the batch's latest row of each series. Either may have it already.

    What is written follows the batch, not the table: last is a log of such rows, which
    ``last_values`` reads as one row a series and ``settle`` shortens now and then.
    """
    history.append_new(batch, VALUE_KEYS, arrival, job, number)
    save_last_values(last, ingest.last_value(batch, "variable_id", "sourcetimestamp", arrival, value).withColumn("is_seed", F.lit(False)), job, number, value)


def save_last_values(last, rows: DataFrame, job: str = "values", number: int | None = None, value: str = "value_double") -> bool:
    """rows (one a series, with is_seed) written to the log behind all that is there."""
    if last.done(job, number):
        return False
    written = F.lit(last.manifest()["version"] + 1).cast("long").alias("written")
    return last.append(rows.select("variable_id", "sourcetimestamp", value, "is_seed", written), job, number)


def last_values(last, value: str = "value_double") -> DataFrame | None:
    """One row a series of the log: a value beats a seed, then the later time, then the later write. None if nothing was ever written."""
    rows = last.read()
    return None if rows is None else _newest(rows, value).drop("written")


def _newest(rows: DataFrame, value: str) -> DataFrame:
    order = F.struct(~F.coalesce("is_seed", F.lit(False)), "sourcetimestamp", "written")
    best = rows.groupBy("variable_id").agg(F.max_by(F.struct("sourcetimestamp", value, "is_seed", "written"), order).alias("best"))
    return best.select("variable_id", "best.*")


def settle(last, value: str = "value_double") -> None:
    """The log as one row a series; care for quiet hours, as compaction is."""
    rows = last.read()
    if rows is not None:
        last.replace(_newest(rows, value))
        last.vacuum()


def seed_values(last, seeds: DataFrame, position: str | None = None, value: str = "value_double") -> int:
    """Seeds for the series that have no row yet, the first of several by position; how many were written."""
    stored = last_values(last, value)
    stored = seeds.limit(0) if stored is None else stored
    counted = Observation()
    fresh = ingest.seed_missing(stored, seeds, position=position).observe(counted, F.count("*").alias("n"))
    save_last_values(last, fresh, "seeds", value=value)
    return counted.get["n"]


def merge_anchors(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Anchors with new ones added; of those there already only a missing legacy_row_id is filled in."""
    if stored is None:
        return rows
    new = rows.select(*ANCHOR_KEYS, F.col("legacy_row_id").alias("new_id"))
    kept = stored.join(new, ANCHOR_KEYS, "left").withColumn("legacy_row_id", F.coalesce("legacy_row_id", "new_id")).select(*stored.columns)
    return kept.unionByName(rows.join(stored.select(*ANCHOR_KEYS), ANCHOR_KEYS, "left_anti").select(*stored.columns))


def typed_rows(events: DataFrame, event_type: str, fields: list[str], payload: str = "props") -> DataFrame:
    """One type's rows with its fields as text columns, taken from the JSON payload."""
    own = events.where(F.col("event_type") == event_type)
    return own.select(*ANCHOR_KEYS, "source_id", *[F.get_json_object(payload, f"$.{f}").alias(f) for f in fields])


def typed_insert(stored: DataFrame | None, rows: DataFrame, arrival: str = "event_id") -> DataFrame:
    """stored with the rows whose (event_id, event_timestamp) it lacks."""
    fresh = ingest.insert_new(stored, rows, ANCHOR_KEYS, arrival)
    return fresh if stored is None else stored.unionByName(fresh, allowMissingColumns=True)


def _decided(batch: DataFrame, stored: DataFrame | None, anchored: DataFrame | None = None) -> DataFrame:
    """The first row of each source and instant, as first, and what is stored there: any row (held), that very event (own), an anchor with a legacy row (linked).

    Where anchored holds another event, rows are left out. All sides are parted by source and
    instant once, by joins that send nothing to every task.
    """
    linked = F.lit(False)
    if anchored is not None:
        at = anchored.groupBy(*EVENT_KEYS).agg(F.min("event_id").alias("least_"), F.max("event_id").alias("most_"), F.max(F.col("legacy_row_id").isNotNull()).alias("linked_"))
        taken = (F.col("least_") != F.col("event_id")) | (F.col("most_") != F.col("event_id"))
        first, linked = F.struct(*batch.columns), F.coalesce("linked_", F.lit(False))
        batch = batch.join(at.hint("merge"), EVENT_KEYS, "left").where(~F.coalesce(taken, F.lit(False)))
    else:
        first = F.struct(*batch.columns)
    rows = batch.groupBy(*EVENT_KEYS).agg(F.min_by(first, "event_id").alias("first"), F.max(linked).alias("linked"))
    if stored is None:
        return rows.withColumn("held", F.lit(False)).withColumn("own", F.lit(False))
    both = rows.join(stored.select(*EVENT_KEYS, F.col("event_id").alias("id_"), F.lit(True).alias("held_")).hint("merge"), EVENT_KEYS, "left")
    marks = [F.coalesce(F.max(c), F.lit(False)).alias(n) for c, n in ((F.col("held_"), "held"), (F.col("id_") == F.col("first.event_id"), "own"))]
    return both.groupBy(*EVENT_KEYS).agg(F.any_value("first").alias("first"), F.max("linked").alias("linked"), *marks)


def save_events(house, batch: DataFrame, schemas: dict[str, list[str]], mode: str | None = None, job: str = "events", number: int | None = None, now: Column | None = None) -> None:
    """A batch of events to the stores that the storage mode names.

    legacy: events alone; v2: anchors, payloads and typed rows; dual: events, anchors and typed
    rows. batch has event_id, source_id, event_type, props and a time (``valid_events``); schemas
    has the fields of the types that have a typed table.

    The first store decides which rows are first at their source and instant; the others take
    only rows that it holds, so none of them has a row without the others. Each table takes a
    numbered batch once: one that failed between two tables is made whole when it is run again.
    An anchor that was written without a legacy row gets a second row with it (``anchors``).
    """
    mode = ingest.storage_mode(mode)
    batch = ingest.valid_events(batch, F.current_timestamp().cast("timestamp_ntz") if now is None else now)
    stored, anchored = house.table("events"), house.table("event_anchor")
    if mode == "legacy":
        stored.append_new(batch, EVENT_KEYS, "event_id", job, number)
        return
    first, others = (stored, [anchored]) if mode == "dual" else (anchored, [house.table("event_payload")])
    if all(t.done(job, number) for t in (first, *others, *[house.table(event_table(t)) for t in schemas])):
        return  # the batch came again, and no store lacks it
    days = stored.days_of(batch)
    held = {t.path: t.read_days(days) for t in (stored, anchored) if t.manifest()["schema"] is not None}
    # an instant that an anchor of v2 holds is taken by its event
    decided = _decided(batch, held.get(first.path), held.get(anchored.path) if mode == "dual" else None).persist()
    try:
        names = [*ANCHOR_KEYS, "source_id", "event_type"]
        won = decided.where("own" if first.done(job, number) else "own or not held")
        if mode == "dual":
            stored.append(decided.where("not held").select("first.*"), job, number)
            anchored.append(won.where("not linked").select("first.*").select(*names, F.col("event_id").alias("legacy_row_id")), job, number)
        else:
            anchored.append(decided.where("not held").select("first.*").select(*names, F.lit(None).cast("bigint").alias("legacy_row_id")), job, number)
            house.table("event_payload").append_new(won.select("first.*").select(*ANCHOR_KEYS, "props"), ANCHOR_KEYS, "event_id", job, number, days)
        for event_type, fields in schemas.items():
            house.table(event_table(event_type)).append_new(typed_rows(won.select("first.*"), event_type, fields), ANCHOR_KEYS, "event_id", job, number, days)
    finally:
        decided.unpersist()


def anchors(house) -> DataFrame | None:
    """One anchor an event, with its legacy row if any row of it has one; conditions on its other columns reach the scan."""
    rows = house.table("event_anchor").read()
    return None if rows is None else rows.groupBy(*ANCHOR_KEYS, "source_id", "event_type").agg(F.max("legacy_row_id").alias("legacy_row_id"))


def payloads(house) -> DataFrame:
    """event_id, event_timestamp and props of every event, from the store that has them."""
    legacy, own = house.table("events").read(), house.table("event_payload").read()
    found = [rows.select(*ANCHOR_KEYS, "props") for rows in (legacy, own) if rows is not None]
    if not found:
        raise ValueError("nothing was ever written")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1].join(found[0].select(*ANCHOR_KEYS).hint("merge"), ANCHOR_KEYS, "left_anti"))


def orphans(house, types: list[str]) -> DataFrame:
    """Typed rows, by type, whose event is not there under their event_id."""
    held = anchors(house).select(*ANCHOR_KEYS).hint("merge")  # as large as the events: sent to no task whole
    counted = [house.table(event_table(t)).read().join(held, ANCHOR_KEYS, "left_anti").agg(F.lit(t).alias("event_type"), F.count("*").alias("orphans")) for t in types]
    return reduce(DataFrame.unionByName, counted)
