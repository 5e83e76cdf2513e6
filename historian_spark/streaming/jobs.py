"""Streams over event files: roll-up, de-duplication, latest values, ingestion in micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import RefreshWindow, refresh
from ..operators.writes import save_events, save_values
from ..sources.tables import work_dir
from ..sources.warehouse import Table


def stream(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """A parquet file or folder as a stream; the rate of files is the back-pressure."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may stand for one file, a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)


def start(df: DataFrame, mode: str, each, checkpoint: str, interval: str | None = None):
    """A running query: each(batch, number) per micro-batch, every interval, or over all that is there now.

    The same checkpoint goes on where an earlier query with it ended; each may be called again
    with a number that failed. Waiting for the query, or its processAllAvailable(), makes what
    was written readable; nothing is dropped when writing is slow, the source waits.
    """
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return df.writeStream.outputMode(mode).trigger(**trigger).option("checkpointLocation", checkpoint).foreachBatch(each).start()


def read_once(each):
    """each, with its batch kept while it runs: the source is then read once, however often the batch is used."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            each(batch, number)
        finally:
            batch.unpersist()

    return run


def run_to_end(df: DataFrame, mode: str, each, checkpoint: str | None = None) -> None:
    """All that is there now, in micro-batches."""
    start(df, mode, each, checkpoint or f"{work_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}").awaitTermination()


def last_state(df: DataFrame) -> DataFrame:
    """The final result table of an aggregation in complete mode, stored once a batch."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/state-{uuid.uuid4().hex}"
    done = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(number)

    run_to_end(df, "complete", each)
    return spark.read.schema(df.schema).parquet(f"{path}/{done[-1]}")


def closed_rows(df: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """What an aggregation gives in append mode: each window once, when the watermark has passed its end; state before it is dropped."""
    spark = df.sparkSession
    target = Table(spark, f"{work_dir(spark)}/closed-{uuid.uuid4().hex}")
    run_to_end(df, "append", lambda batch, number: target.append(batch, "stream", number), checkpoint)
    found = target.read()
    return spark.createDataFrame([], df.schema) if found is None else found


def hourly_rollup(events: DataFrame, late: str = "3 hours") -> DataFrame:
    """Counts by hour, source and type. In append mode windows older than the watermark are closed and later rows of theirs dropped; complete mode keeps all windows."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    counted = timed.groupBy(F.window("t", "1 hour").alias("w"), "user_id", "event_type").agg(F.count("*").alias("event_count"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), F.col("user_id").alias("source_id"), "event_type", "event_count")


def latest_values(events: DataFrame) -> DataFrame:
    best = events.groupBy("user_id").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("b"))
    return best.select(F.col("user_id").alias("variable_id"), F.col("b.ts").alias("sourcetimestamp"), F.col("b.value").alias("value_double"))


def deduplicated(spark: SparkSession, events: DataFrame, keys: list[str], arrival: str, ts: str, unit: str = "day") -> DataFrame:
    """First write wins across batches: within a batch, then against the stored rows of its days."""
    target = Table(spark, f"{work_dir(spark)}/dedup-{uuid.uuid4().hex}", ts, unit)
    run_to_end(events, "append", read_once(lambda batch, number: target.append_new(batch, keys, arrival, "stream", number)))
    return target.read()


def ingest(rows: DataFrame, history: Table, last: Table, checkpoint: str, job: str = "ingest", interval: str | None = None):
    """Values into history (first write wins, added by day) and last values, each batch once, also after a restart."""
    return start(rows, "append", read_once(lambda batch, number: save_values(history, last, batch, job, number)), checkpoint, interval)


def refreshed_rollup(rows: DataFrame, house, checkpoint: str, window: RefreshWindow, interval: str | None = None):
    """Events into the warehouse, and after each batch the roll-up of the hours that its rows touched, within the window; late rows count as long as it holds their hour."""
    stored, rollup, pending = house.table("events"), house.table("event_rollup"), house.table("event_rollup_pending")

    def each(batch: DataFrame, number: int) -> None:
        stored.append_new(batch, ["event_id", "event_timestamp"], "event_id", "rollup", number)
        refresh(rollup, pending, stored, batch, window, number)

    return start(rows, "append", read_once(each), checkpoint, interval)


def newest_state(rows: DataFrame, checkpoint: str, interval: str | None = None):
    """Last values as the state of a streaming aggregation: each batch stores the series that it changes, a restart goes on from them.

    rows: variable_id, sourcetimestamp, value_double, arrival_seq and is_seed. ``state_of`` reads
    the state where the stream keeps it; what this gives on (the changed series) may be ignored.
    """
    order = F.struct((~F.coalesce("is_seed", F.lit(False))).alias("own"), "sourcetimestamp", "arrival_seq")
    best = rows.groupBy("variable_id").agg(F.max(F.struct(order.alias("o"), "value_double")).alias("best"))
    return start(best, "update", lambda batch, number: batch.write.format("noop").mode("overwrite").save(), checkpoint, interval)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The last values that ``newest_state`` holds, read from its state store."""
    rows = spark.read.format("statestore").load(checkpoint)
    held = F.col(f"value.`{rows.schema['value'].dataType.names[0]}`")
    return rows.select("key.variable_id", held["o"]["sourcetimestamp"].alias("sourcetimestamp"), held["value_double"].alias("value_double"), (~held["o"]["own"]).alias("is_seed"))


def ingest_events(rows: DataFrame, house, schemas: dict[str, list[str]], mode: str | None, checkpoint: str, job: str = "events", interval: str | None = None):
    """Events into the stores of the storage mode, each batch once in each table."""
    return start(rows, "append", read_once(lambda batch, number: save_events(house, batch, schemas, mode, job, number)), checkpoint, interval)
