import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import evaluate, intervals, quantize, resample
from varloom.operators import statistics as st
from varloom.sources import draws

CASES = [("pareto", st.pareto_all()), ("mvt", st.MvtAll()), ("mvt", st.mvt_tail()), ("fp", st.fundamental_plane()), ("imf", st.MassFunction())]


@pytest.mark.parametrize("name,T", CASES, ids=lambda v: getattr(v, "name", v))
def test_influence_is_the_derivative(name, T):
    x = draws.draw(name, 3000, 1)
    n, w = len(x), np.ones(len(x))
    psi = T.influence(x, w)
    scale = np.sqrt((psi**2).mean(axis=0))
    assert (np.abs(psi.mean(axis=0)) < 1e-3 * scale).all()
    for i in (0, 17, 1234):
        h = 1e-5
        up, down = w * (1 + h), w * (1 - h)
        up[i] -= h * n
        down[i] += h * n
        assert np.allclose((T(x, down) - T(x, up)) / (2 * h), psi[i], atol=2e-3 * scale.max(), rtol=2e-3)


@pytest.mark.parametrize("name,T", CASES, ids=lambda v: getattr(v, "name", v))
def test_weights_scale_out_and_failures_are_whole(name, T):
    x = draws.draw(name, 500, 2)
    w = np.random.default_rng(0).random(500)
    assert np.allclose(T(x, w), T(x, 3.0 * w), rtol=1e-6)
    assert np.isnan(T(x, np.zeros(500))).all()


def test_truth_is_recovered():
    for (dataset, estimator), c in draws.CASES.items():
        if c.truth is not None and dataset != "fp":
            theta = c.make()(c.draw(20_000, 3), np.ones(20_000))
            assert np.allclose(theta, c.truth, rtol=0.15), (dataset, estimator, theta)


def test_spark_and_numpy_agree(spark):
    for name, T, cols in (("pareto", st.pareto_all(), ["x0"]), ("fp", st.fundamental_plane(), ["x0", "x1", "x2"]), ("imf", st.MassFunction(), ["x0"]), ("mvt", st.mvt_tail(), ["x"])):
        df = draws.points(spark, name, 400, 5, 0, 3)
        got = {r["s"]: [r[o] for o in T.outputs] for r in T.by(df, cols, ["s"]).collect()}
        for s in range(3):
            x = draws.draw(name, 400, 5 + s)
            assert np.allclose(got[s], T(x, np.ones(400)), rtol=1e-9)


def test_partitions_do_not_matter(spark):
    df = draws.points(spark, "pareto", 500, 1)
    one = st.pareto_all().by(df.repartition(1), ["x0"]).first()
    many = st.pareto_all().by(df.repartition(13), ["x0"]).first()
    assert one["alpha"] == pytest.approx(many["alpha"], rel=1e-12)


def test_algebraic_evaluations_are_refits(spark):
    T, x = st.pareto_all(), draws.draw("pareto", 600, 0)
    label = (x > 1.3).astype(int) + (x > 2.0)
    us = [(np.flatnonzero(label == c), np.full((label == c).sum(), 1.0 / (label == c).sum())) for c in range(3)]
    ev = evaluate.Evaluator(T, x)
    ev.delta = 0.01
    fast = ev(us)
    slow = (ev._here(us, np.array([evaluate.step_of(v, 600, 0.01) for _, v in us])) - ev.theta) / np.array([evaluate.step_of(v, 600, 0.01) for _, v in us])[:, None]
    df = spark.createDataFrame([(int(c), float(v)) for c, v in zip(label, x)], "cell int, x0 double")
    rows = {r["cell"]: [r["alpha"], r["P_tail"]] for r in evaluate.spark_batch(T, df, ["x0"], "cell", 0.01).collect()}
    assert np.allclose(fast, slow, rtol=1e-9)
    assert np.allclose(fast, [rows[c] for c in range(3)], rtol=1e-9)


def test_evaluations_approach_the_mean_influence():
    T, x = st.pareto_all(), draws.draw("pareto", 800, 0)
    psi = T.influence(x)
    i = np.flatnonzero(x > 3)
    assert np.allclose(evaluate.Evaluator(T, x)([(i, np.full(len(i), 1 / len(i)))])[0], psi[i].mean(axis=0), rtol=1e-4)


def test_refits_in_spark_do_not_depend_on_tasks(spark):
    T, x = st.DegreesOfFreedom(), draws.draw("mvt", 300, 0)
    us = [(np.arange(k, 300, 7), np.full(len(range(k, 300, 7)), 0.01)) for k in range(4)]
    theta = T(x, np.ones(300))
    a = evaluate.refits(spark, T, x, us, 1e-3, theta, T.eta, tasks=1)
    b = evaluate.refits(spark, T, x, us, 1e-3, theta, T.eta, tasks=4)
    assert (a == b).all()


def test_bootstrap_and_intervals():
    T, x = st.pareto_shape(), draws.draw("pareto", 1000, 0)
    r = resample.bootstrap(T, x, 600, 1)
    assert (r.replicates == resample.bootstrap(T, x, 600, 1, block=7).replicates).all()
    psi = T.influence(x)
    assert r.variance()[0] == pytest.approx((psi**2).mean() / 1000, rel=0.2)
    for kind in ("percentile", "bc", "normal"):
        low, high = r.interval(kind, 0.95)[0]
        assert low < r.theta[0] < high
    half = np.column_stack([np.arange(1.0, 102.0)])  # as many below as above: no correction
    assert intervals.bias_z(half, np.array([51.5]))[0] == pytest.approx(0.0124, abs=1e-3)
    assert np.allclose(intervals.bca_interval(half, np.array([51.5]), 0.0, 0.9), intervals.bc_interval(half, np.array([51.5]), 0.9))


def test_replicate_summary_skips_failures(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, float("nan"))], "a double")
    r = intervals.replicate_summary(df, ["a"], 0.5).first()
    assert (r["n_degenerate"], r["var_a"], r["lo_a"], r["hi_a"]) == (1, pytest.approx(5 / 3), 1.75, 3.25)


def test_poisson_weights_are_poisson(spark):
    w = spark.range(40_000).select(resample.poisson_weight("id", F.lit(3)).alias("w"))
    m = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert m[0] == pytest.approx(1, abs=0.02) and m[1] == pytest.approx(1, abs=0.04)


def test_poisson_bootstrap_has_the_spread(spark):
    df = draws.points(spark, "pareto", 1500, 0)
    r = resample.poisson_bootstrap(st.pareto_shape(), df, ["x0"], "i", 200).toPandas()["alpha"]
    psi = st.pareto_shape().influence(draws.draw("pareto", 1500, 0))
    assert r.var() == pytest.approx((psi**2).mean() / 1500, rel=0.35)


def test_abc_curvature_of_a_square():
    x = np.random.default_rng(0).standard_normal(50) + 3.0
    evaluate_at = lambda w: np.array([(w @ x / w.sum()) ** 2])
    theta = evaluate_at(np.ones(50))
    psi = 2.0 * x.mean() * (x - x.mean())
    c, step, one = intervals.curvature(evaluate_at, theta, psi[:, None], np.full(50, 0.02), 50.0, 1e-12)
    sigma = np.sqrt((psi**2).mean() / 50)
    assert c[0] == pytest.approx(x.var() / (50 * sigma), rel=0.05) and not one[0]


def test_cells():
    assert [quantize.pilot_budget(0.01, d, d) for d in (1, 2, 3)] == [49, 300, 1319]
    x = draws.draw("cloudfil_u", 1500, 0)
    p = quantize.build_cells(x, 40, 0.01, 2)
    assert p.size.sum() == 1500 and (p.size > 0).all() and (p.scale > 0).all()
    a, b = quantize.two_means(x[:100], np.arange(100))
    assert len(a) <= len(b) and len(a) + len(b) == 100
    assert quantize.two_means(np.ones((5, 2)), np.arange(5)) is None


def test_boundary_edges_are_symmetric(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(60)], "id int, x array<double>")
    near = quantize.nearest_two(df, "id", F.col("x"), [(0, [0.0, 0.0]), (1, [3.0, 2.0]), (2, [6.0, 4.0])])
    e = {(r["j"], r["k"]): r["cnt"] for r in quantize.boundary_edges(near).collect()}
    assert all(e[j, k] == e[k, j] for j, k in e)
