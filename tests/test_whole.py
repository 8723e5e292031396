"""That queries take all of their input."""

import numpy as np

from varloom.operators import qij
from varloom.operators.interpolant import Interpolant
from varloom.plans import catalogue


def test_qij_hill_takes_every_order(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    price = 1000.0 + 1000.0 * rng.pareto(2.0, 12_000)
    spark.createDataFrame([(k, float(p)) for k, p in enumerate(price)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    seen, run = [], qij.run
    monkeypatch.setattr(qij, "run", lambda T, x, **o: seen.append(x) or run(T, x, **o))
    row = catalogue.qij_hill(spark, str(tmp_path)).collect()[0]
    assert (seen[0] == price).all()
    r = np.log(price / 1000.0)
    exact = ((1.0 / r.mean() - r / r.mean() ** 2) ** 2).mean()
    assert row["passed"] and abs(row["Vhat"] / exact - 1.0) < 0.02


def test_column_of_one_dimension():
    rng = np.random.default_rng(0)
    for far, cells in ((1.0, "sorted"), (1.0, "mixed"), (1000.0, "sorted")):
        x = far * rng.pareto(1.5, (500, 1))
        x[:20] = x[20]
        label = rng.integers(0, 5, 500) if cells == "mixed" else np.digitize(x[:, 0], np.quantile(x, [0.1, 0.3, 0.5, 0.9]))
        scale = np.array([0.3, 0.5, 0.01, 1.0, 2.0])[label]
        index, weight = rng.permutation(500)[:200], rng.standard_normal(200)
        s = scale[index][:, None] ** 2 + scale[None] ** 2
        kernel = np.exp(-np.sqrt(2.0 / s) * np.abs(x[index] - x.T)) * np.sqrt(2.0 * scale[index][:, None] * scale[None] / s)
        assert np.allclose(Interpolant(x, scale).column(index, weight), weight @ kernel, rtol=0, atol=1e-10)
