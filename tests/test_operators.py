"""Ingestion, temporal operators and retention on cases that the tables lack; every query against its SQL."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from historian_spark import queries as historian
from historian_spark.functions import payload
from historian_spark.functions.buckets import time_bucket
from historian_spark.operators import ingest, reads, registry, retention, temporal

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    v = v.to_pydatetime() if hasattr(v, "to_pydatetime") else v
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(historian.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = historian.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(historian.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 26
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_at_times(spark):
    rows = spark.createDataFrame([(1, T0, 1, 1.0), (1, T0, 2, 2.0), (1, T0 + timedelta(hours=2), 3, 3.0)], "variable_id int, sourcetimestamp timestamp_ntz, value_id long, value_double double")
    asked = spark.createDataFrame([(1, T0 - timedelta(hours=1)), (1, T0), (1, T0 + timedelta(hours=1)), (1, T0 + timedelta(hours=9)), (2, T0)], "variable_id int, at timestamp_ntz")
    got = {(r["variable_id"], r["at"]): r["value_double"] for r in temporal.at_times(asked, rows).collect()}
    assert list(got.values()).count(None) == 2 and got[1, T0] == 2.0 and got[1, T0 + timedelta(hours=9)] == 3.0


def test_merge_last_values(spark):
    kind = "variable_id int, sourcetimestamp timestamp_ntz, value_double double"
    stored = spark.createDataFrame([(1, T0 + timedelta(days=9), 0.0, True), (2, T0, 5.0, False), (3, T0 + timedelta(days=1), 7.0, False)], kind + ", is_seed boolean")
    new = spark.createDataFrame([(1, T0, 1.0, 1), (2, T0, 6.0, 2), (3, T0, 8.0, 3), (4, T0, 9.0, 4), (4, T0, 10.0, 5)], kind + ", arrival_seq long")
    got = {r["variable_id"]: (r["value_double"], r["is_seed"]) for r in ingest.merge_last_values(stored, new).collect()}
    assert got == {1: (1.0, False), 2: (6.0, False), 3: (7.0, False), 4: (10.0, False)}


def test_first_write_and_registration(spark):
    rows = spark.createDataFrame([(1, 1, 5, "b"), (1, 1, 3, "a"), (1, 2, 9, "c")], "k int, t int, seq int, v string")
    assert sorted(r["v"] for r in ingest.first_write(rows, ["k", "t"], "seq").collect()) == ["a", "c"]
    assert ingest.insert_new(rows.where("t = 1"), rows, ["k", "t"], "seq").count() == 1
    dim = spark.createDataFrame([(7, "n1", "Double")], "variable_id long, node_id string, data_type string")
    nodes = spark.createDataFrame([("n1", 0), ("n2", 1), ("n2", 2)], "node_id string, position int")
    got = {r["node_id"]: (r["variable_id"], r["data_type"]) for r in ingest.register(dim, nodes, reset_type=True).collect()}
    assert got == {"n1": (7, "Unknown"), "n2": (8, "Unknown")}


def test_valid_events_and_coverage(spark):
    rows = spark.createDataFrame([("s", "t", None, "x"), ("s", "t", "y", None), (None, "t", "y", "x")], "source_id string, event_type string, Time string, other string")
    assert sorted(r["event_timestamp"] for r in ingest.valid_events(rows, F.lit("now")).collect()) == ["now", "y"]
    none = spark.createDataFrame([], "event_id long")
    assert ingest.coverage(none, none, ["event_id"]).first().asDict() == {"lag": 0, "total": 0, "coverage_pct": 0.0}


def test_retention_edges(spark):
    rows = spark.createDataFrame([(1, T0, 1), (1, T0 - timedelta(microseconds=1), 2)], "k int, ts timestamp_ntz, id int")
    assert [r["id"] for r in retention.trim(rows, "k", "ts", "id", cutoff=T0).collect()] == [1]
    assert retention.trim(rows, "k", "ts", "id", count=5).count() == 2 and retention.trim(rows, "k", "ts", "id", count=1).count() == 1
    pairs = spark.createDataFrame([(5, 9), (9, 5), (None, 5), (5, None), (None, None)], "a int, b int")
    assert [r[0] for r in pairs.select(retention.effective(F.col("a"), F.col("b"))).collect()] == [5, 5, 5, 5, None]


def test_buckets_before_the_origin(spark):
    at = datetime(1999, 12, 31, 23, 59)
    df = spark.createDataFrame([(at,)], "t timestamp_ntz").select(time_bucket(F.col("t"), 7 * 60_000_000))
    assert df.first()[0] <= at < df.first()[0] + timedelta(minutes=7)


def test_payload_and_registry(spark):
    df = spark.createDataFrame([("base64:aGk=",), ("plain",), ("base64:!",), (None,)], "v string")
    assert [r[0] for r in df.select(payload.decode_value(F.col("v"))).collect()][:2] == ["hi", "plain"]
    assert registry.next_version(["a"], 3, ["a"]) == 3 and registry.next_version(["a"], 3, ["b"]) == 4 and registry.next_version(None, 0, []) == 1
    assert registry.widen(spark.range(1), ["a", "x-y", "Time", "b"], {"b": "c"}).columns == ["id", "a", "c"]
    assert reads.continuation([{"event_timestamp": 1, "event_id": 2}], 1) == (1, 2) and reads.continuation([], 1) is None


def test_latest_for_levels(spark):
    kind = "variable_id int, sourcetimestamp timestamp_ntz, value_id long, value_double double"
    history = spark.createDataFrame([(1, T0, 1, 1.0), (2, T0, 2, 2.0)], kind)
    stored = spark.createDataFrame([(1, T0, 9, 9.0)], kind)
    asked = spark.createDataFrame([(1,), (2,), (3,)], "variable_id int")
    args = (history, "variable_id", "sourcetimestamp", "value_id", "value_double")
    assert {r[0]: r[2] for r in reads.latest_for(asked, stored, *args).collect()} == {1: 9.0, 2: 2.0, 3: None}
    assert {r[0]: r[2] for r in reads.latest_for(asked, stored, *args, fallback=False).collect()} == {1: 9.0, 2: None, 3: None}
