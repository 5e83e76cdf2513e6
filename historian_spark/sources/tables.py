"""Parquet tables, the historian's views of them, and a folder for intermediate data."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

_work: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A folder of this session in spark.checkpoint.dir; where that is unset, a temporary one serves a local master only."""
    app = spark.sparkContext.applicationId
    if app not in _work:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="historian-")
        _work[app] = f"{base.rstrip('/')}/historian-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _work[app])
    return _work[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        files.delete(spark, path)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the session's folder and read back."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def event_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("source_id"), "event_type", F.col("ts").alias("event_timestamp"), F.lit(1).alias("schema_version"), F.col("event_id").alias("legacy_row_id"))


def event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("legacy_row_id"), "value", "props")


def typed_events(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """The table of one event type: its fields as columns."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    return e.select("event_id", F.col("ts").alias("event_timestamp"), F.col("user_id").alias("source_id"), F.get_json_object("props", "$.k").alias("k"), "value")


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("value_id"), F.col("user_id").alias("variable_id"), F.col("ts").alias("sourcetimestamp"), F.col("value").alias("value_double"))


def variables_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("variable_id"), F.col("o_orderdate").alias("sourcetimestamp"), F.col("o_totalprice").alias("value_double"), F.col("o_orderkey").alias("arrival_seq"))


def variable_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("variable_id"), F.concat(F.lit("ns=2;i="), F.col("c_custkey")).alias("node_id"), F.lit("Double").alias("data_type"))


def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types, numbered in the order of their names; as many rows as there are types."""
    from pyspark.sql import Window

    names = table(spark, sf_dir, "events").select("event_type").distinct()
    return names.select(F.row_number().over(Window.orderBy("event_type")).alias("event_type_id"), F.concat(F.lit("ns=2;s=Events."), "event_type").alias("event_type_name"))
