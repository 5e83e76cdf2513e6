"""Bounds, naming rules and the filter language, on hand-made rows."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from historian_spark.functions import node_ids, payload
from historian_spark.operators.ingest import storage_mode
from historian_spark.plans import bounds
from historian_spark.plans import filters as fl

NOW = datetime(2024, 2, 1)


def test_bounds():
    a, b = NOW - timedelta(hours=1), NOW
    assert bounds.resolve(a, b, 100, NOW) == bounds.Bounds(a, b, False, 100)
    assert bounds.resolve(None, None, None, NOW) == bounds.Bounds(bounds.NO_TIME, NOW + timedelta(days=1), True, 10_000)
    assert bounds.resolve(b, a, 0, NOW) == bounds.Bounds(a, b, True, 10_000)
    assert bounds.resolve(a, a, 5, NOW).descending


def test_names():
    assert node_ids.format_node_id(2, 5) == "ns=2;i=5" and node_ids.node_id((2, "a")) == "ns=2;s=a"
    assert node_ids.node_id("ns=3;g=x") == "ns=3;g=x" and node_ids.format_node_id(1, 2.5).startswith("ns=1;x=")
    assert node_ids.check_table_name("table-name") == "table-name"
    assert node_ids.flatten({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}
    for bad in ("a b", "a;b", "a'b"):
        with pytest.raises(ValueError):
            node_ids.check_table_name(bad)
    with pytest.raises(TypeError):
        node_ids.node_id(5)


def test_config():
    assert fl.parse_csv_set(" a, b,,") == {"a", "b"} and fl.parse_aliases("a:b, c, :d") == {"a": "b"}
    assert fl.expand_fields({"a"}, {"a": "b", "c": "a"}) == {"a", "b", "c"} and fl.fields_supported({"x"}, set())
    assert [storage_mode(x) for x in (None, "legacy", "V2", "?")] == ["dual", "legacy", "v2", "dual"]
    assert [fl.infer_literal(x) for x in ("true", "5", "5.5", "x")] == [True, 5, 5.5, "x"]


ROWS = [("e1", 300, "Normal operation", "ns=2;i=1234", "Base"), ("e2", 700, "High severity alarm", "ns=2;i=1234", "Alarm"), ("e3", 900, "Critical\nerror", "ns=2;i=5678", "Base"), ("e4", None, None, None, None)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "id string, severity int, message string, source string, type string").cache()


def kept(events, spec):
    return [r["id"] for r in events.where(fl.compile_filter(spec, events.schema)).orderBy("id").collect()]


S, T, M = fl.attribute("severity"), fl.attribute("type"), fl.attribute("message")


@pytest.mark.parametrize(
    "spec,ids",
    [
        ([], "e1 e2 e3 e4"),
        ([fl.element("GreaterThan", S, fl.literal(500))], "e2 e3"),
        ([fl.element("GreaterThanOrEqual", S, fl.literal(700.0))], "e2 e3"),
        ([fl.element("LessThan", S, fl.literal(500))], "e1"),
        ([fl.element("Equals", S, fl.literal("700"))], "e2"),
        ([fl.element("Equals", S, fl.literal(None))], ""),
        ([fl.element("Equals", S)], ""),
        ([fl.element("InList", T, fl.literal("Base"), fl.literal("Alarm"))], "e1 e2 e3"),
        ([fl.element("InList", S, fl.literal(300), fl.literal("900"))], "e1 e3"),
        ([fl.element("Between", S, fl.literal(300), fl.literal(700))], "e1 e2"),
        ([fl.element("Between", S, fl.literal("300"), fl.literal(700))], ""),
        ([fl.element("Like", M, fl.literal("%alarm"))], "e2"),
        ([fl.element("Like", M, fl.literal("Critical%"))], ""),
        ([fl.element("Like", M, fl.literal("%ALARM"))], ""),
        ([fl.element("ILike", M, fl.literal("*ALARM"))], "e2"),
        ([fl.element("IsNull", S)], "e4"),
        ([fl.element("IsNull", fl.attribute("no_such"))], "e1 e2 e3 e4"),
        ([fl.element("IsNull")], ""),
        ([fl.element("And")], "e1 e2 e3 e4"),
        ([fl.element("Equals", S, fl.literal(700)), fl.element("Not", fl.ref(0))], "e1 e3 e4"),
        ([fl.element("Equals", S, fl.literal(700)), fl.element("And", fl.ref(0), fl.literal(1))], ""),
        ([fl.element("Equals", S, fl.literal(700)), fl.element("Or", fl.literal(1), fl.ref(0))], "e2"),
        ([fl.element("GreaterThan", S, fl.literal(500)), fl.element("InList", T, fl.literal("Alarm")), fl.element("And", fl.ref(0), fl.ref(1))], "e2"),
    ],
)
def test_filters(events, spec, ids):
    assert kept(events, spec) == ids.split()


def test_shared_and_cyclic_elements(events):
    shared = [fl.element("Equals", S, fl.literal(700)), fl.element("And", fl.ref(0), fl.ref(0))]
    assert kept(events, shared) == ["e2"]
    strict = fl.compile_filter(shared, events.schema, strict_shared=True)
    assert events.where(strict).count() == 0
    with pytest.raises(ValueError):
        fl.compile_filter([fl.element("Not", fl.ref(0))], events.schema)
    with pytest.warns(UserWarning):
        assert len(kept(events, [fl.element("InView", S)])) == 4


def test_leaves_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "t")
    events.write.parquet(path)
    rows = spark.read.parquet(path)
    spec = [fl.element("GreaterThan", S, fl.literal(5)), *fl.type_filter(["Base"], "type"), fl.element("And", fl.ref(0), fl.ref(1))]
    plan = rows.where(fl.compile_filter(spec, rows.schema))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(severity,5)" in plan and "type" in plan.split("PushedFilters")[1]


def judge(spec, row, k=None):
    """The filter rules row by row, for comparison."""
    e = spec[len(spec) - 1 if k is None else k]
    value = lambda o: row.get(o["attribute"][0]) if "attribute" in o else o.get("literal")
    if e["op"] == "And":
        return all(judge(spec, row, o["element"]) for o in e["operands"])
    if e["op"] == "Or":
        return any(judge(spec, row, o["element"]) for o in e["operands"])
    if e["op"] == "Not":
        return not judge(spec, row, e["operands"][0]["element"])
    a, b = value(e["operands"][0]), value(e["operands"][1])
    if a is None or b is None:
        return False
    if isinstance(a, str) != isinstance(b, str):
        a, b = str(a), str(b)
    return {"Equals": a == b, "GreaterThan": a > b, "LessThan": a < b}[e["op"]]


leaf = st.builds(lambda op, a, v: fl.element(op, a, fl.literal(v)), st.sampled_from(["Equals", "GreaterThan", "LessThan"]), st.sampled_from([S, T]), st.sampled_from([300, 700, 800, "Base", "Alarm", "700"]))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(leaf, min_size=2, max_size=4), st.lists(st.tuples(st.sampled_from(["And", "Or", "Not"]), st.integers(0, 99), st.integers(0, 99)), max_size=4))
def test_random_trees(events, leaves, inner):
    spec = list(leaves)
    for op, a, b in inner:
        spec.append(fl.element(op, *[fl.ref(x % len(spec)) for x in ((a,) if op == "Not" else (a, b))]))
    expected = [r[0] for r in ROWS if judge(spec, {"severity": r[1], "type": r[4]})]
    assert kept(events, spec) == expected


def test_text_of_values(spark):
    """Floats by their shortest digits, as Python writes them."""
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 0.1, 1e-3, 9.99e-4, 1e-4, 9.9e-5, -1.5e-5, 1e7, 12345678.9, 1e15, 1e16, 123456789012345680.0, -1e20, 1.5e300, 5e-324, float("nan"), float("inf"), float("-inf"), None]
    xs += [rng.uniform(1, 10) * 10.0 ** rng.randint(-30, 30) * rng.choice([1, -1]) for _ in range(300)]
    xs += [float(rng.randrange(10**rng.randint(1, 17))) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(payload.text_of(F.col("x"), DoubleType())).collect()]
    wrong = [(g, x) for g, x in zip(got, xs) if g != (None if x is None else repr(x))]
    assert wrong in ([], [("4.9e-324", 5e-324)])
    flags = spark.createDataFrame([(True, "True"), (False, "True"), (None, "None")], "b boolean, s string")
    assert [r[0] for r in flags.select(payload.text_of(F.col("b"), BooleanType())).collect()] == ["True", "False", None]
    assert flags.where(fl.compile_filter([fl.element("Equals", fl.attribute("b"), fl.attribute("s"))], flags.schema)).count() == 1
