"""Prototype influences, the doubled step, two-means and refinement over tables; the root search for nu; replicates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import quantize, resample, survey
from varloom.operators import statistics as st
from varloom.operators.evaluate import step_parameter


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = 1.0 + rng.pareto(2.0, 600)
    cell = np.digitize(x, [1.1, 1.3, 1.7, 2.5, 4.0])
    df = spark.createDataFrame([(int(c), float(v)) for c, v in zip(cell, x, strict=True)] + [(None, 5.0)], "cell int, x double")
    return df, x, cell


def expected(T, x, cell, delta, centre=True):
    k = cell.max() + 1
    p = np.bincount(cell) / len(x)
    m = np.array([x[cell == c].mean() for c in range(k)])
    base, out = T(m, p), []
    for c in range(k):
        t = step_parameter(delta, p[c])
        w = (1 - t) * p
        w[c] += t
        out.append((T(m, w) - base) / t)
    out = np.array(out)
    return p, out - p @ out if centre else out


class Black:
    """The tail index as a statistic without sums."""

    outputs, eta, takes_start, name = ("alpha",), 1e-14, False, "black"

    def __call__(self, x, w, prep=None):
        return np.array([w.sum() / (w @ np.log(np.asarray(x).ravel()))])


@pytest.mark.parametrize("T", [st.pareto_shape(), Black()])
def test_influences_of_prototypes(sample, T):
    df, x, cell = sample
    proto = survey.prototypes(df, "cell", ["x"])
    got = {r["cell"]: r for r in survey.prototype_influences(T, proto, "cell", ["x"], 1e-4).collect()}
    p, want = expected(T, x, cell, 1e-4)
    assert sorted(got) == list(range(len(p)))
    for c, r in got.items():
        assert r["p"] == pytest.approx(p[c]) and r["alpha"] == pytest.approx(want[c, 0], rel=1e-5, abs=1e-6)
    assert sum(r["p"] * r["alpha"] for r in got.values()) == pytest.approx(0.0, abs=1e-8)
    ratio = survey.step_doubling(T, proto, "cell", ["x"], 1e-4).collect()
    assert {r["cell"] for r in ratio} == set(np.argsort(-p, kind="stable")[:5].tolist())
    assert all(r["alpha"] == pytest.approx(2.0, abs=1e-2) for r in ratio)


def test_failures_are_left_out_of_the_centre(spark):
    rows = [(0, 0.5, 1.0), (1, 0.3, float("nan")), (2, 0.2, 4.0), (3, 0.0, None)]
    got = survey.centred(spark.createDataFrame(rows, "cell int, p double, v double"), "p", ["v"]).collect()
    mean = (0.5 * 1.0 + 0.2 * 4.0) / 0.7
    assert [r["v"] for r in sorted(got, key=lambda r: r["cell"])][::2] == pytest.approx([1.0 - mean, 4.0 - mean])
    assert math.isnan(got[1]["v"]) and got[3]["v"] is None
    one = survey.prototypes(spark.createDataFrame([(1, 2.0)], "cell int, x double"), "cell", ["x"])
    assert survey.responses(st.pareto_shape(), one, "cell", ["x"], 0.1).first()["alpha"] is None or math.isnan(survey.responses(st.pareto_shape(), one, "cell", ["x"], 0.1).first()["alpha"])


def test_two_means_of_all_units_at_once(spark):
    rng = np.random.default_rng(7)
    rows = [(u, float(a), float(b), k) for u in range(6) for k, (a, b) in enumerate(rng.normal(size=(40 + 10 * u, 2)) * [1 + u, 1] + (rng.random((40 + 10 * u, 1)) > 0.5) * 3)]
    rows += [(7, 1.0, 1.0, k) for k in range(4)] + [(8, 2.0, 2.0, 0)]
    df = spark.createDataFrame(rows, "unit int, a double, b double, k int")
    cut, rounds = survey.two_means(df, "unit", ["a", "b"])
    got = {(r["unit"], r["k"]): r["side"] for r in cut.collect()}
    assert len(got) == len(rows) and rounds > 2
    for u in range(6):
        own = np.array([[a, b] for v, a, b, _ in rows if v == u])
        one, two = quantize.two_means(own, np.arange(len(own)))
        sides = {s: {k for (v, k), t in got.items() if v == u and t is s} for s in (True, False)}
        assert sorted(map(sorted, sides.values())) == sorted([sorted(one.tolist()), sorted(two.tolist())])
    assert all(s is None for (u, _), s in got.items() if u > 6)
    some, _ = survey.two_means(df, "unit", ["a", "b"], spark.createDataFrame([(2,)], "unit int"))
    assert {r["unit"] for r in some.filter("side IS NOT NULL").collect()} == {2} and some.count() == len(rows)


def test_two_means_runs_until_nothing_moves():
    """A chain along which the sides creep: more than a hundred moves would be cut short by a limit."""
    x = np.concatenate([np.arange(4000) ** 3 / 1e6, [1e6]])[:, None]
    one, two = quantize.two_means(x, np.arange(len(x)))
    a, b = x[one].mean(), x[two].mean()
    assert all(abs(v - a) <= abs(v - b) for v in x[one]) and all(abs(v - b) <= abs(v - a) for v in x[two])


def test_refinement_halves_the_mismatch(spark):
    rng = np.random.default_rng(9)
    x = 1.0 + rng.pareto(2.0, 3000)
    points = spark.createDataFrame([(k, float(v), int(min(v, 3.0))) for k, v in enumerate(x)], "i int, x double, unit int")
    loss = lambda c: F.log(c[0])
    now, totals = survey.refine(points, "unit", ["x"], loss, survey.stored)
    assert all(b <= a + 1e-9 for a, b in zip(totals, totals[1:], strict=False)) and totals[-1] <= 0.5 * totals[0]
    rows = now.collect()
    assert sorted(r["i"] for r in rows) == list(range(3000)) and all(r["x"] == x[r["i"]] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["unit"], []).append(r["x"])
    again = sum(abs(sum(math.log(v) for v in u) - len(u) * math.log(sum(u) / len(u))) for u in by.values())
    assert again == pytest.approx(totals[-1], rel=1e-9) and len(by) > 3
    for u in by.values():  # finer than before: a unit lies in one old unit
        assert len({int(min(v, 3.0)) for v in u}) == 1
    same = spark.createDataFrame([(0, 1.0, 0), (1, 1.0, 0)], "i int, x double, unit int")
    assert survey.refine(same, "unit", ["x"], loss, survey.stored)[1] == [0.0]


def test_root_of_nu_in_six_passes(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_t(4, size=(3000, 1)) * np.ones((1, 1))
    T = st.DegreesOfFreedom(1)
    r2 = (x**2).sum(axis=1)
    df = spark.createDataFrame([(float(v), 1.0 + k % 2) for k, v in enumerate(r2)] + [(None, 1.0), (1.0, 0.0)], "r2 double, w double")
    n, nu, passes = T.of_table(df, F.col("r2"), F.col("w"))
    assert n == 3000 and passes <= 6 and nu == pytest.approx(T(x, 1.0 + np.arange(3000) % 2)[0], rel=1e-9)
    flat = spark.createDataFrame([(1e-6,)] * 10, "r2 double")
    assert math.isnan(T.of_table(flat, F.col("r2"))[1]) == math.isnan(T(np.full((10, 1), 1e-3), np.ones(10))[0])
    assert T.of_table(flat.limit(0), F.col("r2"))[0] == 0


def test_poisson_quantile(spark):
    u = [0.0, 0.3678, 0.3679, 0.7357, 0.7358, 0.9196, 0.9198, 1.0 - 2.0**-52]
    want = [sum(t <= v for t in resample.STEPS) for v in u]
    got = spark.createDataFrame([(v,) for v in u], "u double").select(resample.poisson_quantile(F.col("u")).alias("k"))
    assert [r["k"] for r in got.collect()] == want


def test_replicates_have_small_code(spark):
    """No weight is written out more than once in the plan."""
    df = spark.createDataFrame([(1, 2.0)], "i long, x double")
    plan = resample.poisson_bootstrap(st.pareto_shape(), df, ["x"], "i", 500)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") <= 2 and plan.count("CASE WHEN") <= 2
