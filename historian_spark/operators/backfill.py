"""Backfill of anchors and typed rows from legacy events, in resumable batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.node_ids import event_table
from .ingest import backfill_seeds, coverage, numbered
from .writes import ANCHOR_KEYS, anchors, last_values, payloads, save_last_values, typed_rows


def next_batch(legacy: DataFrame, anchors: DataFrame, after: int, size: int, id_column: str = "event_id") -> DataFrame:
    """The first rows behind the cursor that have no anchor yet, in order of id; top-k, so only they are moved."""
    missing = legacy.where(F.col(id_column) > after).join(anchors.select(id_column), id_column, "left_anti")
    return missing.orderBy(id_column).limit(size)


def progress(legacy: DataFrame, anchors: DataFrame, after: int, size: int, id_column: str = "event_id") -> DataFrame:
    """One row: where the next batch ends (null when nothing is left), how many rows it has, lag, total and coverage."""
    batch = next_batch(legacy, anchors, after, size, id_column).agg(F.max(id_column).alias("cursor"), F.count("*").alias("rows"))
    return batch.join(coverage(legacy.select(id_column), anchors.select(id_column), [id_column]))


def missing_typed(anchors: DataFrame, storage: DataFrame, typed: DataFrame, events: DataFrame, event_type: str, fields: list[str]) -> DataFrame:
    """Typed rows of anchors whose type has a table and that the table lacks, old ones as well as new."""
    held = anchors.join(storage, "event_type", "left").where("table_name is not null and event_type is not null")
    todo = held.where(F.col("event_type") == event_type).join(typed.select(*ANCHOR_KEYS), ANCHOR_KEYS, "left_anti")
    return typed_rows(events.join(todo.select(*ANCHOR_KEYS), ANCHOR_KEYS, "left_semi"), event_type, fields)


def run(house, size: int, id_column: str = "event_id") -> int:
    """All missing anchors of the warehouse's events, a batch at a time; the cursor is the table's own job number, so a restart goes on. How many batches."""
    legacy, target, n = house.table("events").read(), house.table("event_anchor"), 0
    after = target.manifest()["jobs"].get("backfill", -1)
    while True:
        anchors = target.read()
        anchors = legacy.limit(0).select(*ANCHOR_KEYS) if anchors is None else anchors
        batch = next_batch(legacy, anchors, after, size, id_column)
        end = batch.agg(F.max(id_column)).first()[0]
        if end is None:
            return n
        target.append(batch.select(*ANCHOR_KEYS, "source_id", "event_type", F.col(id_column).alias("legacy_row_id")), "backfill", end)
        after, n = end, n + 1


def missing_of_types(house, schemas: dict[str, list[str]], after: int) -> DataFrame:
    """Anchors behind an id whose type has a table that lacks them, old ones as well as new."""
    own = anchors(house).where((F.col("event_id") > after) & F.col("event_type").isin(list(schemas)))
    held = [rows.select(*ANCHOR_KEYS) for t in schemas if (rows := house.table(event_table(t)).read()) is not None]
    return own.join(reduce(DataFrame.unionByName, held).hint("merge"), ANCHOR_KEYS, "left_anti") if held else own


def batch_ends(rows: DataFrame, size: int, id_column: str = "event_id") -> list[int]:
    """The last id of each batch of size rows in order of id; a number a batch comes to the driver, and no task orders all rows."""
    nth = numbered(rows.select(id_column), id_column, "nth")
    found = nth.groupBy(F.floor((F.col("nth") - 1) / size).alias("batch")).agg(F.max(id_column).alias("end")).collect()
    return sorted({r["end"] for r in found})


def run_typed(house, schemas: dict[str, list[str]], size: int, job: str = "typed_backfill") -> int:
    """The typed rows that are missing for the warehouse's anchors, all types in one pass over the ids. How many batches.

    A batch is the next ``size`` anchors without a typed row, by id (rows of one id stay together).
    What is missing is looked up once for all batches, and again when they are through. The cursor
    is the batch number of the typed tables' job, the least of them: a batch that ended between two
    tables is run again, and the tables that have it pass it over. A job of another name begins anew.
    """
    tables = {t: house.table(event_table(t)) for t in schemas}
    after, n = min(table.manifest()["jobs"].get(job, -1) for table in tables.values()), 0
    while True:
        missing = missing_of_types(house, schemas, after).persist()
        try:
            ends = batch_ends(missing, size)
            if not ends:
                return n
            for end in ends:
                own = (F.col("event_id") > after) & (F.col("event_id") <= end)  # on both sides, so other batches' payloads are not moved
                batch = missing.where(own).join(payloads(house).where(own).hint("merge"), ANCHOR_KEYS).persist()
                try:
                    for event_type, fields in schemas.items():
                        tables[event_type].append_new(typed_rows(batch, event_type, fields), ANCHOR_KEYS, "event_id", job, end)
                finally:
                    batch.unpersist()
                after, n = end, n + 1
        finally:
            missing.unpersist()


def restore(last, history: DataFrame, chunks: int, on_chunk: Callable[[dict], None] | None = None, job: str = "restore", staged: Callable[[DataFrame], DataFrame] | None = None, value: str = "value_double") -> list[dict]:
    """Seeds of the log of last values replaced by the history's last values; no series stays a seed. Figures of each chunk.

    The history is read once, for all seeds; the result is written to the log a chunk of series at
    a time, each counted while it is written: found in the history, missing there, and cleared.
    on_chunk gets these figures. A restart passes over the chunks that the log has; staged stores
    the result for the chunks (else each is computed anew).
    """
    stored = last_values(last, value)
    seeds = stored.where("is_seed")
    found = backfill_seeds(seeds, history.join(seeds.select("variable_id"), "variable_id", "left_semi"), value=value)
    found = found.withColumn("chunk", F.pmod("variable_id", F.lit(chunks)))
    found = found if staged is None else staged(found)
    figures = []
    for chunk in range(chunks):
        if last.done(job, chunk):
            continue
        counted = Observation()
        rows = found.where(F.col("chunk") == chunk).observe(counted, F.count_if("restored").alias("found"), F.count_if(~F.col("restored")).alias("missing"), F.count("*").alias("cleared"))
        save_last_values(last, rows, job, chunk, value)
        figures.append({"chunk": chunk} | counted.get)
        if on_chunk is not None:
            on_chunk(figures[-1])
    return figures
