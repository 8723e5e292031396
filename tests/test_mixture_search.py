"""The search for mixtures and its moves, in memory and over a table, and the information matrix."""

import math

import numpy as np
import pytest

from varloom.operators import mixture as mx
from varloom.operators import mixture_search as search
from varloom.operators import table_mixture as tm


def differences(f, u):
    out = []
    for i in range(len(u)):
        h = 1e-5 * max(1.0, abs(u[i]))
        up, down = u.copy(), u.copy()
        up[i] += h
        down[i] -= h
        out.append((f(up) - f(down)) / (2 * h))
    return np.array(out)


def case(thread, seed=0, n=400):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(n, 2)) * [2.0, 1.2], 2.0 * rng.random(n)
    cov = np.array([[[1, 0.3], [0.3, 0.8]], [[0.2, -0.05], [-0.05, 0.4]], [[2, 0.5], [0.5, 1]]])
    p = mx.Parameters(np.array([0.3, 0.2, 0.1, 0.4] if thread else [0.3, 0.2, 0.5]), rng.normal(size=(3, 2)), cov, np.array([0.1, 1.5, 0.05, 0.55, 0.02, 0.05]) if thread else None)
    return mx.Data(x, w), p


def blobs(seed, k=6, n=60):
    rng = np.random.default_rng(seed)
    mu = rng.normal(size=(k, 2)) * 2.0
    return np.concatenate([mu[j] + rng.normal(size=(n, 2)) @ np.linalg.cholesky(np.diag(rng.uniform(0.1, 0.8, 2)) + 0.05).T for j in range(k)])


@pytest.mark.parametrize("thread", [False, True])
def test_information_is_the_second_derivative(thread):
    data, p = case(thread)
    u = mx.to_free(p)
    value, g, h = data.information(u, 3, thread)
    assert value == pytest.approx(data.log_likelihood(p), rel=1e-14)
    assert np.allclose(g, differences(lambda v: data.log_likelihood(mx.from_free(v, 3, thread)), u), atol=1e-6)
    assert np.allclose(h, h.T, atol=1e-10) and np.allclose(h, differences(lambda v: mx.gradient(data, v, 3, thread), u), atol=2e-6)
    moved = mx.Data(data.x, data.w * 1.0)
    moved.cov = data.cov + np.array([[0.0, 1e-6], [1e-6, 0.0]])
    slope = (mx.penalty_gradient(moved, u, 3, thread) - mx.penalty_gradient(data, u, 3, thread)) / 1e-6
    assert np.allclose(slope, -data.a * by_cov12(data, u, thread), atol=1e-8)


def by_cov12(data, u, thread):
    out = np.zeros(len(u))
    free = 3 if thread else 2
    out[free + 6 : free + 15] = mx._penalty_terms(data.cov, u, 3, thread)[2][:, :, 1].reshape(-1)
    return out


def test_remaining_gain():
    series = [10.0 - 4.0 * 0.5**k for k in range(4)]
    assert search.remaining(series) == pytest.approx(10.0 - series[-1])
    assert search.remaining([0.0, 1.0, 2.5]) == math.inf and search.remaining([1.0, 1.0, 1.0]) == 0.0 == search.remaining([0.0, 1.0, 0.5])


@pytest.mark.parametrize("thread", [False, True])
def test_acceleration_never_loses(thread):
    data, p = case(thread, 2)
    longest, values = [4.0], []
    for _ in range(25):
        p, v, _ = search.squarem(data, [p], longest)[0]
        values.append(v)
    assert np.diff(values).min() > -1e-9 * abs(values[0])
    q, v = search.accelerated(data, p, 1e-12, 400, gradient=True)
    assert search.scaled_gradient(data, q) <= 1e-6 and v >= values[-1] - 1e-9 * abs(v)


def test_no_dropped_start_would_have_won(monkeypatch):
    """Over 50 data sets: followed by plain EM from where it was dropped, no start beats the race's winner."""
    real, dropped = search.limit, []

    def spied(engine, p):
        bound = real(engine, p)
        dropped.append((bound, p))
        return bound

    monkeypatch.setattr(search, "limit", spied)
    gone = 0
    for seed in range(50):
        x = blobs(seed, 4, 40)
        data = mx.Data(x, np.ones(len(x)))
        dropped.clear()
        left = search.race(data, [mx.kmeans_start(data, 4, 100 + s) for s in range(8)], keep=1)
        best = max(search.accelerated(data, p, 1e-10, 400)[1] for *_, p in left)
        for bound, p in [d for d in dropped if d[0] < left[0][0]]:
            gone += 1
            for _ in range(150):
                p, v = data.em(p)
            assert v <= best + 1e-6 * abs(best)
    assert gone > 100


@pytest.mark.parametrize("seed", [6, 31, 51])
def test_split_and_merge_where_relocation_is_stuck(seed):
    x = blobs(seed)
    data = mx.Data(x, np.ones(len(x)))
    p, v = search.accelerated(data, mx.kmeans_start(data, 6, seed), 1e-10, 400)
    p, v = search.relocated(data, p, v, mx.Cells(data, 180, seed), 1e-10)
    again = search.relocated(data, p, v, mx.Cells(data, 180, seed + 1), 1e-10)[1]
    q, better, tried, accepted = search.split_merge(data, p, v, 1e-9)
    assert better > max(v, again) + 0.5 and accepted >= 1 and tried >= 5
    assert data.log_likelihood(q) == pytest.approx(better, rel=1e-6)


def test_proposals_do_not_depend_on_labels():
    data, p = case(False, 4)
    order = np.array([2, 0, 1])
    merge, split = data.move_scores(p)
    other, worst = data.move_scores(p.permuted(order))
    assert np.allclose(other, merge[np.ix_(order, order)]) and np.allclose(worst, split[order])
    one = search.proposals(p, merge, split)
    two = [tuple(int(order[c]) for c in v) for v in search.proposals(p.permuted(order), other, worst)]
    assert [(sorted(v[:2]), v[2]) for v in one] == [(sorted(v[:2]), v[2]) for v in two]
    q = search.proposed(p, *one[0])
    assert q.w.sum() == pytest.approx(1.0) and q.feasible()


def test_merged_moments():
    _, p = case(False)
    w, mean, cov = search.merged(p, 0, 2)
    rng = np.random.default_rng(1)
    draws = np.concatenate([rng.multivariate_normal(p.mean[c], p.cov[c], int(2e5 * p.w[c])) for c in (0, 2)])
    assert w == pytest.approx(0.8) and np.allclose(mean, draws.mean(axis=0), atol=0.02) and np.allclose(cov, np.cov(draws.T), atol=0.05)


def test_insertion_drops_no_winner(monkeypatch):
    """The same cell as when every candidate is followed to its end."""
    for seed in range(8):
        x = blobs(seed, 5, 50)
        data = mx.Data(x, np.ones(len(x)))
        cells = mx.Cells(data, 100, seed)
        p, _ = search.accelerated(data, mx.kmeans_start(data, 3, seed), 1e-8, 100)
        gain, got = search.best_insertion(data, p, cells, eta=1e-9, cap=200)
        every = []
        for j in range(len(cells.share)):
            one = type("One", (), {"share": cells.share[j : j + 1], "mean": cells.mean[j : j + 1], "cov": cells.cov[j : j + 1]})
            every.append(search.best_insertion(data, p, one, eta=1e-9, cap=200)[0])
        assert gain == pytest.approx(max(every), abs=1e-3)
        assert got.k == 4 and got.w.sum() == pytest.approx(1.0)


@pytest.fixture(scope="module")
def shared(spark):
    x = blobs(3, 3, 150)
    rows = [(float(a), float(b), 1.0 + k % 3) for k, (a, b) in enumerate(x)]
    nothing = [(None, 1.0, 1.0), (float("nan"), 0.0, 1.0), (1.0, float("inf"), 1.0), (1.0, 1.0, 0.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows + nothing, "a double, b double, c double").repartition(2)
    return tm.TableData(df, "a", "b", "c"), mx.Data(x, np.array([r[2] for r in rows]))


@pytest.mark.parametrize("thread", [False, True])
def test_table_and_memory_agree(shared, thread):
    table, data = shared
    assert table.n == len(data.x) and table.total == data.total and np.allclose(table.cov, data.cov)
    _, p = case(thread)
    (q, v), (r, u) = table.em(p), data.em(p)
    assert v == pytest.approx(u, rel=1e-12) and np.allclose(q.vector(), r.vector())
    free = mx.to_free(p)
    for a, b in zip(table.information(free, 3, thread), data.information(free, 3, thread), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-8)
    assert table.log_likelihood(p) == pytest.approx(data.log_likelihood(p), rel=1e-12)
    for a, b in zip(table.move_scores(p), data.move_scores(p), strict=True):
        assert np.allclose(a, b)
    candidates = np.array([0.1, 0.2]), p.mean[:2] + 0.5, p.cov[:2]
    assert np.allclose(table.against(p)(*candidates), data.against(p)(*candidates))


def test_a_race_is_one_pass_a_step(shared):
    table, data = shared
    starts = tm.sampled_starts(table, 3, 6)
    assert len(starts) == 6 and all(s.feasible() for s in starts)
    before = table.passes
    one = table.em_all(starts)
    assert table.passes == before + 1
    for (p, v), (q, u) in zip(one, data.em_all(starts), strict=True):
        assert v == pytest.approx(u) and np.allclose(p.vector(), q.vector())


def test_cold_fit_of_a_table(spark, shared):
    table, data = shared
    before = table.passes
    p, value, status = tm.fit_engine(table, 2, starts=2)
    assert table.passes - before < 250
    best = max(search.accelerated(data, mx.kmeans_start(data, 2, s), 1e-12, 400)[1] for s in range(10))
    assert status == "converged" and value >= best - 1e-6 * abs(best)
    with pytest.raises(ValueError, match="no point"):
        tm.TableData(spark.createDataFrame([(None, 1.0)], "a double, b double"), "a", "b")
    cells = tm.GridCells(table, least=1)
    assert cells.share.sum() == pytest.approx(1.0) and np.allclose(cells.share @ cells.mean, table.centre)
