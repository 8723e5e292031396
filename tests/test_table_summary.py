"""The cold search on a table's summary."""

import numpy as np
import pytest

from varloom.operators import mixture as mx
from varloom.operators import mixture_search as search
from varloom.operators import table_mixture as tm


@pytest.fixture(scope="module")
def close(spark):
    """Two components whose EM is slow, and a heavy value."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.multivariate_normal(m, c, n) for m, c, n in (([0, 0], [[1, 0.3], [0.3, 1]], 1200), ([1.2, 0.8], [[0.6, 0], [0, 1.5]], 800))])
    x[:200] = [0.25, -0.5]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double").repartition(2)
    return tm.TableData(df, "a", "b"), mx.Data(x, np.ones(len(x)))


def test_summary_is_the_table(close):
    table, data = close
    summary = tm.Summary(table)
    assert summary.w.sum() == pytest.approx(2000) and np.allclose(summary.w @ summary.x / 2000, table.centre)
    assert np.allclose(summary.w @ summary.terms[:, 3:], [(data.x[:, 0] ** 2).sum(), (data.x[:, 0] * data.x[:, 1]).sum(), (data.x[:, 1] ** 2).sum()])
    p = mx.Parameters(np.array([0.5, 0.5]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.array([np.eye(2), 0.5 * np.eye(2)]))
    (q, v), (r, u) = summary.em_all([p])[0], data.em(p)
    assert v <= u and v == pytest.approx(u, rel=1e-3) and np.allclose(q.vector(), r.vector(), atol=0.01)
    wide = tm.Summary(table, side=2)  # coarse squares do not draw components onto their means
    q, _ = search.accelerated(wide, p, 1e-10, 200)
    assert np.linalg.eigvalsh(q.cov).min() > 0.1


def test_cold_fit_takes_few_passes(close):
    table, data = close
    before = table.passes
    _, value, status = tm.fit_engine(table, 2, starts=8)
    assert table.passes - before <= 40
    best = max(mx.finished(data, search.accelerated(data, mx.kmeans_start(data, 2, s), 1e-10, 400)[0], 1e-10)[1] for s in range(6))
    assert status == "converged" and value >= best - 1e-6 * abs(best)


def test_places_met_twice_are_one():
    p = mx.Parameters(np.array([0.3, 0.7]), np.array([[0.0, 0.0], [1.0, 1.0]]), np.tile(np.eye(2), (2, 1, 1)))
    other = mx.Parameters(p.w, p.mean + 0.5, p.cov)
    assert tm.distinct([(p, 1.0), (other, 3.0), (p.permuted(np.array([1, 0])), 2.0)], np.eye(2))[0] is other
    assert len(tm.distinct([(p, 1.0), (other, 3.0), (p.permuted(np.array([1, 0])), 2.0)], np.eye(2))) == 2
