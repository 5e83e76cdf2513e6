"""op11_whitening against covariances in exact fractions, numpy's of all rows at once, and hard rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from historian_spark.llm import common, queries, whitening  # noqa: E402

COLUMNS = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


@pytest.fixture(scope="module")
def run(spark):
    common.ship(spark)

    def call(rows, kind="float"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("x", "dim", "v", "scaled")}).repartition(5)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(queries, "table", lambda s, d, t: table)
            df = queries.op11_whitening(spark, "")
        assert dict(df.dtypes) == COLUMNS
        return df.collect()

    return call


def expected(rows):
    """n, and of each row: deviation, whitened (up to the sign of a component); explained; all of rows of one length."""
    x = [[math.floor(256 * float(c)) for c in v] for v in rows]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    own = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], own @ v[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def test_op11(run):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) + 3).astype(np.float32)
    x[100:180] = x[99]  # one vector many times
    x[5] = -0.001  # entries below zero round down
    bad = [None, [None] * 12, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [1e30] * 12, []]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v) for k, v in enumerate(bad)] + [(None, x[7].tolist()), (3, x[3].tolist())]
    got = run(rows)
    valid = [*range(400), 7, 3]
    n, deviation, whitened, explained = expected([x[k] for k in valid])
    assert n == 320 and len(got) == 4 * len(valid) and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9
    for c in range(4):
        own = {(r["vec_id"], r["deviation"]): r for r in got if r["component"] == c + 1}
        sign = np.sign(own[0, deviation[0]]["whitened"] * whitened[0][c])
        for k in range(400):
            r = own[k, deviation[k]]
            assert r["whitened"] == pytest.approx(sign * whitened[k][c], abs=1e-9) and r["explained"] == pytest.approx(explained[c], rel=1e-9)
        assert own[None, deviation[7]]["whitened"] == own[7, deviation[7]]["whitened"]


def test_op11_of_little(run):
    assert run([]) == [] and run([(1, None), (2, [])]) == []
    one = run([(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    line = run([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)} and line[0]["identity_error"] < 1e-12
    mixed = run([(k, [float(k), float(k * k), 1.0][: 2 + k % 2]) for k in range(40)])
    assert {(r["vec_id"] % 2, r["n"]) for r in mixed} == {(0, 20), (1, 20)} and {r["component"] for r in mixed if r["vec_id"] % 2} == {1, 2, 3}


def test_op11_beyond_a_long(run):
    """Sums and deviations are whole numbers of any size; what no long holds is null."""
    far = [[2.0**40 + 2.0**20 * k, float(k)] for k in range(50)]
    got = [r for r in run(list(enumerate(far)), "double") if r["component"] == 1]
    _, deviation, whitened, _ = expected(far)
    by = {r["vec_id"]: r for r in got}
    assert [by[k]["deviation"] for k in range(50)] == [d if d < 2**63 else None for d in deviation] and None in {r["deviation"] for r in got}
    assert all(abs(by[k]["whitened"]) == pytest.approx(abs(whitened[k][0]), rel=1e-9, abs=1e-9) for k in range(50))


def test_chan_merging_equals_one_pass():
    x = np.random.default_rng(2).integers(-900, 900, (1000, 5)) + 10**6
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 10, 500])]
    a, b = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3])), whitening.Moments.of(x)
    assert a.sums == b.sums == x.sum(axis=0).tolist() and a.n == 1000
    assert np.allclose(a.scatter, np.cov(x.T, bias=True) * 1000, rtol=1e-12)
