"""Writing once whatever is run again, typed reads, filter plans, retention by folders, figures."""

import json
import logging
import operator
import warnings
from datetime import UTC, date, datetime, timedelta
from functools import reduce
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from historian_spark import __main__ as cli
from historian_spark import observe
from historian_spark.operators import backfill, ingest, reads, registry, temporal, typed, writes
from historian_spark.plans import bounds, planner
from historian_spark.plans import filters as fl
from historian_spark.sources import files, tables
from historian_spark.sources.warehouse import Table, Warehouse, probe
from historian_spark.streaming import jobs

T0 = datetime(2024, 1, 1)
VALUES = "variable_id long, sourcetimestamp timestamp_ntz, value_double double, arrival_seq long"


def values(spark, *rows):
    return spark.createDataFrame([(k, T0 + timedelta(days=t), float(v), s) for k, t, v, s in rows], VALUES)


def test_a_batch_counts_once(spark, tmp_path):
    history, last = Table(spark, str(tmp_path / "h"), "sourcetimestamp"), Table(spark, str(tmp_path / "l"))
    first, second = values(spark, (1, 0, 1, 1), (1, 0, 9, 2), (2, 1, 2, 3)), values(spark, (1, 0, 7, 4), (1, 2, 8, 5))
    for _ in range(2):
        writes.save_values(history, last, first, number=0)
    # the second batch fails between the two tables, after a restart it is run again
    assert Table(spark, history.path, "sourcetimestamp").append_new(second, writes.VALUE_KEYS, "arrival_seq", "values", 1)
    for _ in range(2):
        writes.save_values(Table(spark, history.path, "sourcetimestamp"), Table(spark, last.path), second, number=1)
    assert sorted((r["variable_id"], r["value_double"]) for r in history.read().collect()) == [(1, 1.0), (1, 8.0), (2, 2.0)]
    assert sorted((r["variable_id"], r["value_double"]) for r in writes.last_values(last).collect()) == [(1, 8.0), (2, 2.0)]
    assert history.manifest()["jobs"] == {"values": 1}


def test_days_months_and_care(spark, tmp_path):
    rows = values(spark, *[(1, t, t, t) for t in range(0, 60, 5)])
    for unit, dropped, left in (("day", 6, 6), ("month", 1, 5)):
        table = Table(spark, str(tmp_path / unit), "sourcetimestamp", unit)
        assert table.read() is None
        table.append(rows.where("arrival_seq < 30"))
        table.append(rows.where("arrival_seq >= 30"))
        plan = reads.plan_text(table.read(date(2024, 1, 3), date(2024, 1, 12)))
        assert "PartitionFilters: [isnotnull(day" in plan and table.read(date(2024, 1, 3), date(2024, 1, 12)).count() == 2
        table.compact()
        assert len(table.manifest()["parts"]) == 1 and table.read().count() == 12 and len(table.days()) == (12 if unit == "day" else 2)
        assert table.retain(30, datetime(2024, 2, 29) if unit == "day" else datetime(2024, 3, 20)) == dropped and table.read().count() == left
        with pytest.raises(ValueError):
            table.retain(0, T0)
        table.clear()
        assert table.read().count() == 0 and table.read().columns == rows.columns


def test_warehouse(spark, tmp_path, capsys):
    house, ran = Warehouse(spark, str(tmp_path)), []
    steps = [("001", lambda h: ran.append(1)), ("002", lambda h: h.table("variables").append(values(spark, (1, 0, 1, 1))))]
    assert house.migrate(steps) == ["001", "002"] and house.migrate([*steps, ("003", lambda h: ran.append(3))]) == ["003"] and ran == [1, 3]
    assert cli.main([str(tmp_path), "info"], spark) == 0
    info = json.loads(capsys.readouterr().out)
    assert [x["table_name"] for x in info] == ["variables"] and info[0]["row_count"] == 1
    assert cli.main([str(tmp_path), "retain", "variables", "1"], spark) == 0 and json.loads(capsys.readouterr().out) == {"dropped": 1}
    assert probe(spark, str(tmp_path / "none"))["exists"] is False and probe(spark, "/root/testdata/sf0.001/region.parquet")["columns"][0] == "r_regionkey"
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path), "retain", "last_values", "1"], spark)


def test_readers_that_began_before_end_well(spark, tmp_path):
    """Retention, compaction and replacement take nothing from a frame that is read already; later vacuums do."""
    table = Table(spark, str(tmp_path / "t"), "sourcetimestamp")
    for k in range(3):
        table.append(values(spark, *[(1, t, t, t) for t in range(k, 30, 3)]))
    early = table.read()
    assert table.set_policy(20, T0 + timedelta(days=30)) == 10 and table.read().count() == 20 and Table(spark, table.path).policy() == 20
    table.compact()
    table.replace(values(spark, (1, 40, 1, 1)))
    assert early.count() == 30 and table.read().count() == 1 and table.vacuum() == 0
    assert table.vacuum(now=datetime.now(UTC) + timedelta(hours=2)) > 0
    assert files.usage(spark, f"{table.path}/data")[0] == 2 and table.read().count() == 1  # its file and the mark of a write that ended
    assert table.apply_policy(T0 + timedelta(days=90)) == 1 and table.read().count() == 0
    with pytest.raises(ValueError):
        table.set_policy(0)


def test_figures_come_from_footers(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    house.table("variables").append(values(spark, *[(1, t, t, t) for t in range(30)]).coalesce(1))
    house.table("variables").append(values(spark, (1, 29, 1, 1)).coalesce(1))
    plan = reads.plan_text(house.table("variables").stats("day"))
    assert "value_double" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert house.table("variables").days(2) == [{"day": "2024-01-30", "files": 2, "bytes": house.table("variables").days(1)[0]["bytes"], "row_count": 2}, {"day": "2024-01-29", "files": 1, "bytes": house.table("variables").days(2)[1]["bytes"], "row_count": 1}]
    assert [(x["table_name"], x["row_count"], x["files"]) for x in house.info()] == [("variables", 31, 31)] and house.stats().count() == 1


def test_added_columns_stay(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([(1,)], "a int"))
    table.append(spark.createDataFrame([(2, "x")], "a int, b string"))
    assert sorted((r["a"], r["b"]) for r in table.read().collect()) == [(1, None), (2, "x")]


def test_storage_modes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "a", T0, '{"k": 1}'), (2, 5, "b", T0, '{"k": 2}'), (3, None, "a", T0, "{}"), (4, 6, "a", T0, '{"k": 4}')], "event_id long, source_id long, event_type string, event_timestamp timestamp_ntz, props string")
    for mode, names in (("legacy", ["events"]), ("v2", ["event_anchor", "event_payload", "evt_a"]), (None, ["event_anchor", "events", "evt_a"])):
        house = Warehouse(spark, str(tmp_path / str(mode)))
        writes.save_events(house, rows, {"a": ["k"]}, mode, number=0)
        writes.save_events(house, rows, {"a": ["k"]}, mode, number=0)
        assert house.names() == names
        # the type is no part of the key, so event 2 gives way to event 1
        assert {r["event_id"] for r in house.table(names[0]).read().collect()} == {1, 4}
    assert sorted((r["event_id"], r["k"]) for r in house.table("evt_a").read().collect()) == [(1, "1"), (4, "4")]


def test_what_is_written_follows_the_batch(spark, tmp_path):
    """A batch of one row adds a few KB to a log of 20,000 series, and settling leaves one row a series."""
    history, last = Table(spark, str(tmp_path / "h"), "sourcetimestamp"), Table(spark, str(tmp_path / "l"))
    many = spark.range(20_000).select(F.col("id").alias("variable_id"), F.lit(T0).alias("sourcetimestamp"), F.rand(1).alias("value_double"), F.col("id").alias("arrival_seq"))
    sizes = []
    for number, batch in enumerate([many, values(spark, (7, 1, 70, 1)), values(spark, (7, 1, 71, 2)), values(spark, (7, 0, 72, 3))]):
        writes.save_values(history, last, batch, number=number)
        sizes.append(files.usage(spark, f"{last.path}/data")[1])
    assert sizes[0] > 100_000 and all(b - a < 6_000 for a, b in zip(sizes, sizes[1:]))
    for _ in range(2):
        found = {r["variable_id"]: r["value_double"] for r in writes.last_values(last).collect()}
        assert len(found) == 20_000 and found[7] == 71.0  # of equal times the later write, whatever older ones come after it
        writes.settle(last)
    assert last.read().count() == 20_000 and last.manifest()["jobs"] == {"values": 3}


def test_seeds_give_way_to_values(spark, tmp_path):
    last = Table(spark, str(tmp_path / "l"))
    seeds = spark.createDataFrame([(1, T0 + timedelta(days=9), 0.5, 0), (1, T0, 0.7, 1), (2, T0, 0.0, 2)], "variable_id long, sourcetimestamp timestamp_ntz, value_double double, position int")
    assert writes.seed_values(last, seeds, "position") == 2 and writes.seed_values(last, seeds, "position") == 0
    writes.save_values(Table(spark, str(tmp_path / "h"), "sourcetimestamp"), last, values(spark, (1, 0, 4, 1), (3, 0, 5, 2)), number=0)
    assert {r["variable_id"]: (r["value_double"], r["is_seed"]) for r in writes.last_values(last).collect()} == {1: (4.0, False), 2: (0.0, True), 3: (5.0, False)}
    assert writes.seed_values(last, seeds.selectExpr("4L as variable_id", "sourcetimestamp", "value_double", "position"), "position") == 1


def test_rows_without_a_time_are_told_apart_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "sourcetimestamp")
    rows = spark.createDataFrame([(1, None, 1.0, 1), (1, None, 2.0, 2), (None, T0, 3.0, 3)], VALUES)
    for _ in range(2):
        table.append_new(rows, writes.VALUE_KEYS, "arrival_seq")
    assert sorted(r["value_double"] for r in table.read().collect()) == [1.0, 3.0]


def test_only_the_batch_s_days_are_read(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "sourcetimestamp")
    table.append(values(spark, *[(1, t, t, t) for t in range(0, 60, 5)]))
    plan = reads.plan_text(table.read_days_of(values(spark, (1, 0, 0, 0), (1, 55, 0, 0))))
    assert "day#" in plan and "2024-01-01" in plan.split("PartitionFilters")[1] and table.read_days_of(values(spark, (1, 0, 0, 0), (1, 55, 0, 0))).count() == 2


EVENTS = "event_id long, source_id long, event_type string, event_timestamp timestamp_ntz, props string"


def test_no_typed_row_without_its_event(spark, tmp_path):
    """Two events at one source and instant, in one batch or in two, and a batch that ends between two tables."""
    first = spark.createDataFrame([(1, 5, "info", T0, '{"x": "only here"}'), (2, 5, "error", T0, '{"k": 2}')], EVENTS)
    later = spark.createDataFrame([(3, 5, "error", T0, '{"k": 3}'), (4, 6, "error", T0, '{"k": 4}'), (4, 6, "error", T0, '{"k": 4}')], EVENTS)
    for mode in ("dual", "v2"):
        house = Warehouse(spark, str(tmp_path / mode))
        writes.save_events(house, first, {"error": ["k"]}, mode, number=0)
        # the first store has the batch, the others do not yet
        if mode == "dual":
            house.table("events").append_new(later, writes.EVENT_KEYS, "event_id", "events", 1)
        for _ in range(2):
            writes.save_events(Warehouse(spark, house.path), later, {"error": ["k"]}, mode, number=1)
        assert [(r["event_id"], r["k"]) for r in house.table("evt_error").read().collect()] == [(4, "4")]
        assert sorted(r["event_id"] for r in writes.anchors(house).collect()) == [1, 4]
        assert {r["event_id"]: r["props"] for r in writes.payloads(house).collect()} == {1: '{"x": "only here"}', 4: '{"k": 4}'}
        assert [r["orphans"] for r in writes.orphans(house, ["error"]).collect()] == [0]


def test_times_of_events_in_the_writing_path(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 5, "a", T0, None, "{}"), (2, 5, "a", None, T0 + timedelta(days=1), "{}"), (3, 5, "a", None, None, "{}"), (4, 5, None, T0, None, "{}")], "event_id long, source_id long, event_type string, Time timestamp_ntz, other timestamp_ntz, props string")
    writes.save_events(house, rows.withColumnRenamed("other", "event_timestamp"), {}, "legacy", now=reads.ntz("2024-03-01"))
    assert {r["event_id"]: r["event_timestamp"] for r in house.table("events").read().collect()} == {1: T0, 2: T0 + timedelta(days=1), 3: datetime(2024, 3, 1)}


def test_typed_backfill_goes_on_where_it_ended(spark, tmp_path):
    """Old rows and new, several types, a batch that one table has and the other lacks, and rows that come afterwards."""
    house = Warehouse(spark, str(tmp_path))
    rows = spark.createDataFrame([(k, 1, "ab"[k % 2], T0 + timedelta(minutes=k), f'{{"x": {k}}}') for k in range(20)], EVENTS)
    writes.save_events(house, rows, {}, "dual", number=0)
    schemas = {"a": ["x"], "b": ["x"]}
    house.table("evt_a").append(writes.typed_rows(rows.where("event_id = 4"), "a", ["x"]))
    first = backfill.missing_of_types(house, schemas, -1).orderBy("event_id").limit(6)
    assert [r["event_id"] for r in first.collect()] == [0, 1, 2, 3, 5, 6]
    house.table("evt_a").append_new(writes.typed_rows(first.join(writes.payloads(house), writes.ANCHOR_KEYS), "a", ["x"]), writes.ANCHOR_KEYS, "event_id", "typed_backfill", 6)
    assert backfill.run_typed(house, schemas, 6) == 3 and backfill.run_typed(house, schemas, 6) == 0
    held = {t: sorted((r["event_id"], r["x"]) for r in house.table(f"evt_{t}").read().collect()) for t in "ab"}
    assert held == {"a": [(k, str(k)) for k in range(0, 20, 2)], "b": [(k, str(k)) for k in range(1, 20, 2)]}
    writes.save_events(house, spark.createDataFrame([(30, 2, "b", T0, '{"x": 1}')], EVENTS), {}, "dual", number=1)
    assert backfill.run_typed(house, schemas, 6) == 1 and house.table("evt_b").read().count() == 11


def test_restore_tells_of_each_chunk_once(spark, tmp_path):
    last, told = Table(spark, str(tmp_path / "l")), []
    seeds = spark.createDataFrame([(k, T0 - timedelta(days=9), 0.0) for k in range(10)], "variable_id long, sourcetimestamp timestamp_ntz, value_double double")
    history = spark.createDataFrame([(k, T0 + timedelta(days=d), 10 * k + d, float(10 * k + d)) for k in range(6) for d in (0, 1)], "variable_id long, sourcetimestamp timestamp_ntz, value_id long, value_double double")
    writes.seed_values(last, seeds)

    def stops(figures):
        told.append(figures)
        if len(told) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        backfill.restore(last, history, 3, stops)
    assert [x["chunk"] for x in backfill.restore(last, history, 3)] == [2] and backfill.restore(last, history, 3) == []
    assert told == [{"chunk": 0, "found": 2, "missing": 2, "cleared": 4}, {"chunk": 1, "found": 2, "missing": 1, "cleared": 3}]
    got = {r["variable_id"]: (r["value_double"], r["is_seed"]) for r in writes.last_values(last).collect()}
    assert got == {k: (10.0 * k + 1 if k < 6 else 0.0, False) for k in range(10)}


def test_only_touched_hours_are_counted_again(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    tables = [house.table(n) for n in ("event_rollup", "event_rollup_pending", "events")]
    batch = lambda *minutes: spark.createDataFrame([(1000 * len(minutes) + k, 1, "a", T0 + timedelta(minutes=m)) for k, m in enumerate(minutes)], "event_id long, source_id long, event_type string, event_timestamp timestamp_ntz")

    def step(number, *minutes):
        tables[2].append(batch(*minutes), "events", number)
        for _ in range(2):
            temporal.refresh(*tables, batch(*minutes), temporal.RefreshWindow(), number)
        return {(r["bucket"] - T0) // timedelta(hours=1): r["event_count"] for r in temporal.refreshed(tables[0]).collect()}

    # the newest hour waits, hours older than three are never counted
    assert step(0, 5, 70, 130, 190, 250) == {1: 1, 2: 1}
    written = tables[0].read().count()
    assert step(1, 130, 251) == {1: 1, 2: 2}
    assert tables[0].read().count() == written + 1 and sorted((r["bucket"] - T0) // timedelta(hours=1) for r in tables[1].read().collect()) == [3, 4]
    assert step(2, 6, 310) == {1: 1, 2: 2, 3: 1}
    # rolled up, but not to the second table: the batch is made whole
    tables[2].append(batch(311, 371, 372), "events", 3)
    lost = house.table("other")
    temporal.refresh(tables[0], lost, tables[2], batch(311, 371, 372), temporal.RefreshWindow(), 3)
    temporal.refresh(*tables, batch(311, 371, 372), temporal.RefreshWindow(), 3)
    assert sorted((r["bucket"] - T0) // timedelta(hours=1) for r in tables[1].read().collect()) == [5, 6]


def test_state_follows_the_batch(spark, tmp_path):
    """A restart goes on from the state; a batch of one row adds a few KB to a state of 20,000 series."""
    path, at = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    many = spark.range(20_000).select(F.col("id").alias("variable_id"), F.lit(T0).alias("sourcetimestamp"), F.rand(1).alias("value_double"), F.col("id").alias("arrival_seq"), (F.col("id") == 9).alias("is_seed"))
    sizes = []
    for batch in (many, many.where("variable_id = 7").withColumn("value_double", F.lit(70.0)).withColumn("arrival_seq", F.lit(20_001)), many.where("variable_id = 9").withColumns({"value_double": F.lit(90.0), "is_seed": F.lit(False), "sourcetimestamp": F.lit(T0 - timedelta(days=1)).cast("timestamp")})):
        batch.coalesce(1).write.mode("append").parquet(path)
        jobs.newest_state(jobs.stream(spark, path), at).awaitTermination()
        sizes.append(files.usage(spark, f"{at}/state")[1])
    got = {r["variable_id"]: (r["value_double"], r["is_seed"]) for r in jobs.state_of(spark, at).collect()}
    assert len(got) == 20_000 and got[7] == (70.0, False) and got[9] == (90.0, False)
    assert sizes[0] > 200_000 and all(b - a < 20_000 for a, b in zip(sizes, sizes[1:]))


def test_schemas_are_found_and_versioned(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    for number, rows in enumerate([[("a", '{"x": 1}'), ("b", '{"y": 1, "x": null}'), ("c", None), ("c", "[1]"), ("c", "{}")], [("a", '{"x": 2}')], [("a", '{"x": 1, "z": {"w": 1}}'), ("d", '{"q": 0}')]]):
        for _ in range(2):
            registry.register_events(house, spark.createDataFrame(rows, "event_type string, props string"), number=number)
    got = sorted((r["event_type"], r["schema_version"], r["fields"]) for r in house.table("event_schemas").read().collect())
    assert got == [("a", 1, ["x"]), ("a", 2, ["x", "z"]), ("b", 1, ["x", "y"]), ("d", 1, ["q"])]


def test_requests_without_a_time_keep_their_rows(spark):
    rows = spark.createDataFrame([(1, T0, 1, 1.0), (None, T0, 2, 2.0), (1, None, 3, 3.0)], "variable_id int, sourcetimestamp timestamp_ntz, value_id long, value_double double")
    asked = spark.createDataFrame([(1, T0), (1, None), (None, T0), (None, None), (2, T0)], "variable_id int, at timestamp_ntz")
    got = sorted(((r["variable_id"], r["at"], r["value_double"]) for r in temporal.at_times(asked, rows).collect()), key=str)
    assert got == sorted([(1, T0, 1.0), (1, None, None), (None, T0, None), (None, None, None), (2, T0, None)], key=str)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    history, last = Table(spark, str(tmp_path / "h"), "sourcetimestamp"), Table(spark, str(tmp_path / "l"))
    for turn in range(2):
        values(spark, (1, turn, turn, turn), (2, 0, 5 + turn, 10 + turn)).coalesce(1).write.mode("append").parquet(path)
        query = jobs.ingest(jobs.stream(spark, path), history, last, at)
        query.awaitTermination()
    assert sorted((r["variable_id"], r["value_double"]) for r in history.read().collect()) == [(1, 0.0), (1, 1.0), (2, 5.0)]
    assert {r["variable_id"]: r["value_double"] for r in writes.last_values(last).collect()} == {1: 1.0, 2: 6.0}
    report = observe.stream_report(query)
    assert report["counts"]["items"] == 2 and not report["active"]


# typed reads
EVENT = "event_id long, event_timestamp timestamp_ntz, source_id long"


@pytest.fixture(scope="module")
def typed_tables(spark):
    ids = [(k, T0 + timedelta(minutes=k // 2), 1) for k in range(8)]
    anchor = spark.createDataFrame([(*r, "ten" if r[0] % 2 else "eleven") for r in ids], EVENT + ", event_type string")
    ten = spark.createDataFrame([(*r, f"S{r[0]}", None) for r in ids if r[0] % 2], EVENT + ", serial string, dev_eui string")
    eleven = spark.createDataFrame([(*r, f"s{r[0]}") for r in ids if not r[0] % 2], EVENT + ", serial string")
    return anchor, {"ten": ten, "eleven": eleven}


def test_typed_pages_follow_one_another(typed_tables):
    anchor, own = typed_tables
    b, cursor, seen = bounds.resolve(T0, T0 + timedelta(hours=1), 3, T0), None, []
    while True:
        rows = typed.read_typed(anchor, own, None, b, cursor=cursor).collect()
        seen += [r["event_id"] for r in rows]
        cursor = reads.continuation(rows, b.limit)
        if cursor is None:
            break
    assert seen == list(range(8))


def test_typed_filters_see_every_type(typed_tables):
    anchor, own = typed_tables
    b = bounds.resolve(T0, T0 + timedelta(hours=1), None, T0)
    ids = lambda types, spec: sorted(r["event_id"] for r in typed.read_typed(anchor, own, types, b, spec).collect())
    assert ids(["ten"], [fl.element("ILike", fl.attribute("serial"), fl.literal("s*"))]) == [1, 3, 5, 7]
    assert ids(["ten", "none"], None) == [1, 3, 5, 7] and ids(["none"], None) == []
    # a type without the field has nulls there and is not left out
    assert ids(None, [fl.element("IsNull", fl.attribute("dev_eui"))]) == list(range(8))
    limited = typed.read_typed(anchor, own, None, bounds.resolve(T0, T0 + timedelta(hours=1), 2, T0), [fl.element("Equals", fl.attribute("serial"), fl.literal("S5"))])
    assert [r["event_id"] for r in limited.collect()] == [5]


# plans
E = fl.element
A, L, R = fl.attribute, fl.literal, fl.ref


def test_plans():
    both = planner.build([E("Equals", A("serial"), L("abc")), E("IsNull", A("dev_eui")), E("And", R(0), R(1))])
    assert both.shown() == "(serial Equals 'abc' and dev_eui IsNull)" and both.fields() == ["dev_eui", "serial"]
    assert planner.build([]).shown() == "all" and planner.build([E("InView", A("x"))]).elements == []
    assert planner.build([E("Equals", A("a"), L(1)), E("Equals", A("b"), A("c"))]).elements == []
    assert planner.build([E("IsNull", A("b")), E("Equals", A("a"), L(1))], allowed={"b"}).elements == []
    assert planner.build([E("Equals", A("Body", "eui"), L("1"))], aliases={"eui": "dev_eui"}).fields() == ["dev_eui"]
    assert planner.build([E("InList", A(), L(7))]).types() == ([7], [])
    plan = planner.build([E("InList", A("EventType"), L(1), L("ns=2;s=Events.X")), E("Like", A("serial"), L("%x%")), E("And", R(0), R(1))])
    assert plan.types() == ([1], []) and plan.without_types().shown() == "serial Like '%x%'" and plan.restricted({"other"}).shown() == "EventType InList 1 'ns=2;s=Events.X'"
    assert planner.build([E("InList", A("EventType"), L("Events.A"), L("ns=2;s=Events.B"), L("string"))]).types() == ([], ["A", "B", "string"])
    assert plan.possible(["1", "2"]) == ["1"]


def test_what_plans_give_up():
    # an Or with a part that cannot be planned, or that is taken away, is given up as a whole; an And goes on
    spec = [E("Equals", A("a"), L("1")), E("Equals", A("b"), A("a")), E("Or", R(0), R(1))]
    assert planner.build(spec).elements == []
    mixed = [*spec[:2], E("And", R(0), R(1)), E("IsNull", A("c")), E("Or", R(2), R(3)), E("Not", R(2)), E("And", R(4), R(5))]
    assert planner.build(mixed).shown() == "(a Equals '1' or c IsNull)"
    spec = [E("InList", A("EventType"), L("X")), E("Equals", A("a"), L("1")), E("Or", R(0), R(1))]
    plan = planner.build(spec)
    assert plan.types() is None and plan.without_types().elements == [] and plan.restricted({"b"}).elements == [] and plan.possible(["Y"]) == ["Y"]
    assert planner.build([E("And", R(0))]).elements == []


MIXED = "s string, d double, n int, t boolean, EventType string"


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([("abc", 1.5, 1, True, "x"), ("a.c", 7.0, 7, False, "y"), (None, None, None, None, None), ("true", 1e20, 2, None, "x"), ("7", -0.0, 0, True, "7"), ("7.0", float("nan"), 5, False, "z")], MIXED).cache()


@pytest.mark.parametrize("spec", [E("Like", A("s"), L("a.c")), E("Equals", A("t"), L(True)), E("Equals", A("s"), L(True)), E("Equals", A("d"), L(1e20)), E("Equals", A("s"), L(1e20)), E("Equals", A("d"), L("abc")), E("InList", A("d"), L("7"), L("x")), E("InList", A("d"), L("7.0")), E("Like", A("s"), L("[a.]_c%"))], ids=str)
def test_plans_mean_what_their_filters_do(mixed, spec):
    rows = lambda c: mixed.where(c).count()
    whole, plan = fl.compile_filter([spec], mixed.schema), planner.build([spec]).column(mixed.schema)
    assert rows(whole) == rows(plan) == rows(whole & plan)


_LEAF = st.builds(lambda op, f, vs: E(op, A(f), *map(L, vs[: {"InList": 3, "Between": 2, "IsNull": 0}.get(op, 1)])), st.sampled_from(["Equals", "GreaterThan", "LessThan", "InList", "Between", "Like", "ILike", "IsNull", "InView"]), st.sampled_from(["s", "d", "n", "t", "EventType", "missing"]), st.lists(st.sampled_from(["abc", "a.c", "7", "true", "x", "%", "a_c", "[a.]%"]) | st.sampled_from([7, 1, True, 1e20, 1.5, None]), min_size=3, max_size=3))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_LEAF, min_size=2, max_size=4), st.lists(st.tuples(st.sampled_from(["And", "Or", "Not"]), st.integers(0, 99), st.integers(0, 99)), max_size=5), st.sets(st.sampled_from(["s", "d", "n", "t"])))
def test_plans_are_never_stricter_than_filters(mixed, leaves, inner, some):
    spec = list(leaves)
    for op, a, b in inner:
        spec.append(E(op, *[R(x % len(spec)) for x in ((a,) if op == "Not" else (a, b))]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        passed = mixed.where(fl.compile_filter(spec, mixed.schema))
    plan = planner.build(spec)
    weaker = [w.column(mixed.schema) for w in (plan, plan.without_types(), plan.restricted(some), planner.build(spec, allowed=some))]
    assert passed.where(~reduce(operator.and_, [F.coalesce(w, F.lit(False)) for w in weaker])).count() == 0


def test_typed_reads_ask_the_plan_early(spark, tmp_path):
    """A condition beneath Or reaches both scans, and a type that cannot fit is not read."""
    anchor = spark.createDataFrame([(k, T0 + timedelta(minutes=k), 1, "ab"[k % 2]) for k in range(8)], EVENT + ", event_type string")
    fields = {t: spark.createDataFrame([(k, T0 + timedelta(minutes=k), 1, str(k), float(k)) for k in range(8) if "ab"[k % 2] == t], EVENT + ", serial string, level double") for t in "ab"}
    for name, df in {"anchor": anchor, **fields}.items():
        df.write.parquet(str(tmp_path / name))
    stored = {n: spark.read.parquet(str(tmp_path / n)) for n in ("anchor", "a", "b")}
    b = bounds.resolve(T0, T0 + timedelta(hours=1), None, T0)
    spec = [E("InList", A("event_type"), L("a")), E("Equals", A("serial"), L("4")), E("GreaterThan", A("level"), L(5)), E("Or", R(1), R(2)), E("And", R(0), R(3))]
    rows = typed.read_typed(stored["anchor"], {t: stored[t] for t in "ab"}, None, b, spec)
    assert sorted(r["event_id"] for r in rows.collect()) == [4, 6]
    plan = reads.plan_text(rows)
    assert f"{tmp_path}/b]" not in plan and "Or(EqualTo(serial,4),GreaterThan(level,5.0))" in plan.replace(" ", "")
    none = typed.read_typed(stored["anchor"], {t: stored[t] for t in "ab"}, None, b, [E("Equals", A("event_type"), L("c"))])
    assert none.count() == 0 and none.columns == ["event_id", "event_timestamp", "source_id", "event_type", "serial", "level"]


def test_types_are_stripped_beneath_and_alone(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "event_type string, v int")
    fit = lambda spec: [r["v"] for r in rows.where(fl.compile_filter(fl.strip_types(spec), rows.schema)).orderBy("v").collect()]
    types = fl.type_filter(["a"])
    assert fit(types) == [1, 2] and fit([*types, E("Not", R(0))]) == [2]
    assert fit([*types, E("Equals", A("v"), L(5)), E("Or", R(0), R(1))]) == [1]
    assert fit([*types, E("Equals", A("v"), L(2)), E("And", R(0), R(1))]) == [2] and fl.strip_types([]) == []
    with pytest.raises(ValueError):
        fl.strip_types([E("And", R(0))])


def test_mistakes_make_a_filter_false(spark):
    rows = spark.createDataFrame([("a", 1)], "event_type string, v int")
    spec = [E("Like", A("event_type"), L(5)), E("Equals", A("v"), L(1)), E("Or", R(0), R(1))]
    assert rows.where(fl.compile_filter(spec, rows.schema)).count() == 0
    with pytest.raises(ValueError):
        fl.compile_filter(spec, rows.schema, strict_errors=True)


# values that an exact type would not hold
@pytest.mark.parametrize("xs,average,total", [([1e-7], 1e-7, 1e-7), ([0.1234567, 0.1234567], 0.1234567, 0.2469134), ([1e13, 3e13], 2e13, 4e13), ([1e300], 1e300, 1e300), ([float("inf"), 1.0], float("inf"), float("inf")), ([float("nan"), 1.0], float("nan"), float("nan"))])
def test_processed_values(spark, xs, average, total):
    rows = spark.createDataFrame([(1, T0, x) for x in xs], "variable_id long, sourcetimestamp timestamp_ntz, value_double double")
    for name, expected in (("Average", average), ("TimeAverage", average), ("Total", total), ("Variance", average)):
        got = temporal.processed(rows, temporal.AggregatePlan.of(T0, T0 + timedelta(days=1), name)).first()
        assert got["aggregate_value"] == pytest.approx(expected, rel=1e-12, nan_ok=True) and got["sample_count"] == len(xs)


def test_first_seed_and_numbers(spark):
    seeds = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b"), (3, 0, "x")], "variable_id long, position int, v string")
    got = ingest.seed_missing(seeds.where("variable_id = 3"), seeds, position="position").collect()
    assert sorted((r["variable_id"], r["v"], r["is_seed"]) for r in got) == [(1, "a", True), (2, "b", True)]
    rows = spark.range(0, 30_000, 3).withColumnRenamed("id", "position")
    assert ingest.numbered(rows, "position", "n").where("n <> position / 3 + 1").count() == 0


def test_registry_and_levels(spark):
    schemas = spark.createDataFrame([(1, 1, ["a"])], "event_type_id int, schema_version int, fields array<string>")
    assert registry.allowed_fields({"x"}, schemas) == {"x"} and registry.allowed_fields(set(), schemas, {"a": "b"}) == {"a", "b"}
    assert registry.sync(schemas, 1, ["a"]).count() == 1 and registry.sync(schemas, 1, ["b"]).count() == 2


def test_figures_and_logs():
    meter = observe.Meter()
    for ms in (3, 1, 2):
        meter.took("flush", ms)
    meter.add("items", 3)
    assert meter.timed("f", lambda x: x + 1, 1) == 2
    assert meter.report()["timings"]["flush"] == {"count": 3, "total_ms": 6, "last_ms": 2, "max_ms": 3, "avg_ms": 2} and meter.report()["counts"] == {"items": 3}
    assert observe.settings_nodes({"a": {"b": 1}}) == {"a.b": 1}
    now, log = [0.0], observe.Throttled(10, 5, clock=lambda: now[0])
    passed = []
    for t in (0, 9, 11, 12, 15, 16):
        now[0] = t
        record = logging.LogRecord("x", logging.ERROR, "", 0, "down", (), None)
        passed.append(record.getMessage() if log.filter(record) else None)
    assert passed == ["down", "down", None, None, "down (2 more like it)", None]


def test_no_temporary_folder_off_a_local_master():
    class Away:
        class sparkContext:  # noqa: N801
            applicationId, master = "away", "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(key, other):
                return other

    with pytest.raises(ValueError):
        tables.work_dir(Away)


EVENTS = "event_id long, source_id long, event_type string, event_timestamp timestamp_ntz, props string"


def events(spark, n: int):
    return spark.createDataFrame([(i, i % 7, "ab"[i % 2], T0 + timedelta(hours=i // 9), '{"x": 1}') for i in range(n)], EVENTS)


def test_stores_are_sent_to_no_task_whole(spark, tmp_path):
    """what is stored is as large as the table, so no write may broadcast it."""
    house, rows, bus = Warehouse(spark, str(tmp_path)), events(spark, 200), spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    for number, (mode, part) in enumerate((("v2", "event_id % 3 = 0"), ("v2", "event_id % 3 <= 1"), ("dual", "event_id % 3 <= 1"), ("dual", "event_id >= 0"))):
        writes.save_events(house, rows.where(part), {"a": ["x"], "b": ["x"]}, mode, number=number)
    assert [r["orphans"] for r in writes.orphans(house, ["a", "b"]).collect()] == [0, 0]
    bus.waitUntilEmpty()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())]
    assert len(plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]


def test_a_batch_is_decided_once_for_all_stores(spark, tmp_path):
    """the batch is read for its days and for the decision, not anew for each table."""
    house, seen = Warehouse(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    for number, mode in enumerate(("v2", "dual", "dual")):
        before = seen.value
        writes.save_events(house, events(spark, 90).mapInArrow(counted, EVENTS), {"a": ["x"], "b": ["x"]}, mode, number=number)
        assert seen.value - before <= 180
    assert house.table("events").read().count() == house.table("evt_a").read().count() + house.table("evt_b").read().count()


def test_a_day_has_few_files(spark, tmp_path):
    """a write makes files by the days' sizes, not one a day and task."""
    table = Table(spark, str(tmp_path), "event_timestamp")
    table.append(events(spark, 400).repartition(8, "event_id"))
    assert table.stats().first()["files"] == len(table.days(99)) == 2


def test_backfill_takes_rows_of_one_id_together(spark, tmp_path):
    """F8: batches are cut by id without ordering all rows in a task; rows of one id are never parted by a batch's end."""
    house = Warehouse(spark, str(tmp_path))
    rows = events(spark, 40).withColumn("event_id", F.floor(F.col("event_id") / 4))
    house.table("events").append(rows)
    house.table("event_anchor").append(rows.select("event_id", "event_timestamp", "source_id", "event_type", F.col("event_id").alias("legacy_row_id")))
    want = rows.groupBy("event_type").agg(F.countDistinct("event_id", "event_timestamp").alias("n")).collect()
    for t in "ab":
        house.table(f"evt_{t}").append(writes.typed_rows(rows.limit(0), t, ["x"]))
    assert backfill.run_typed(house, {"a": ["x"], "b": ["x"]}, 3) >= 5
    assert {r["event_type"]: r["n"] for r in want} == {t: house.table(f"evt_{t}").read().count() for t in "ab"}


def _events_folder(spark, path, n: int, parts: int, step: int = 1) -> str:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * step % 2_500_000).cast("timestamp_ntz")
    rows = spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 900).alias("user_id"), F.lit("a").alias("event_type"), F.rand(1).alias("value"), F.lit("{}").alias("props"))
    rows.repartition(parts).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_late_rows_come_in_small_row_groups(spark, tmp_path):
    """a row group is the least that a task reads, so one group a file held all windows of the file in one task's memory."""
    import pyarrow.parquet as pq

    from historian_spark.queries import QUERIES

    before = set(Path(tables.work_dir(spark)).glob("late-*"))
    assert QUERIES["stream_late_rows"](spark, _events_folder(spark, tmp_path, 600_000, 4)).count() > 0
    (path,) = set(Path(tables.work_dir(spark)).glob("late-*")) - before
    files_ = sorted(path.glob("*.parquet"), key=lambda f: f.stat().st_size)
    assert len(files_) == 3 and pq.ParquetFile(files_[-1]).num_row_groups > 1


def test_refreshed_rollup_is_fed_by_many_tasks(spark, tmp_path):
    """an arrival is written by as many tasks as one micro-batch takes files, not by one."""
    from historian_spark.queries import QUERIES

    before = set(Path(tables.work_dir(spark)).glob("house-*"))
    assert QUERIES["stream_rollup_refreshed"](spark, _events_folder(spark, tmp_path, 20_000, 4, 125)).count() > 0
    (path,) = set(Path(tables.work_dir(spark)).glob("house-*")) - before
    turns = len(list((path / "checkpoint" / "offsets").glob("[0-9]*")))
    assert turns < len(list((path / "in").glob("*.parquet"))) <= 16 * turns


@pytest.mark.parametrize("mode", ["v2", "dual"])
def test_batch_that_came_again_starts_no_job(spark, tmp_path, mode):
    house = Warehouse(spark, str(tmp_path / "house"))
    rows = spark.createDataFrame([(1, 1, "error", T0, "{}"), (2, 1, "view", T0 + timedelta(days=1), "{}")], "event_id long, source_id long, event_type string, event_timestamp timestamp_ntz, props string")
    jobs_of = []
    for turn in range(2):
        spark.sparkContext.setJobGroup(f"turn-{mode}-{turn}", "")
        writes.save_events(house, rows, {"error": ["k"]}, mode, number=0)
        jobs_of.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"turn-{mode}-{turn}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs_of[0] and not jobs_of[1], jobs_of
    assert writes.anchors(house).count() == 2
