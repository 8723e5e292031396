"""The certified method on tables that are beyond the driver."""

import numpy as np
import pytest

from varloom.operators import qij, qij_table
from varloom.operators import statistics as st
from varloom.plans import catalogue


def write(spark, folder, price):
    df = spark.createDataFrame([(k, float(p)) for k, p in enumerate(price)], "o_orderkey long, o_totalprice double")
    df.repartition(3).write.parquet(f"{folder}/orders.parquet")
    return spark.read.parquet(f"{folder}/orders.parquet")


def exact(price):
    r = np.log(np.asarray(price) / 1000.0)
    return ((1.0 / r.mean() - r / r.mean() ** 2) ** 2).mean()


def test_qij_hill_beyond_the_driver(spark, tmp_path, monkeypatch):
    price = 1000.0 + 1000.0 * np.random.default_rng(3).pareto(2.0, 12_000)
    write(spark, tmp_path, price)
    monkeypatch.setattr(catalogue, "SMALL", 1 << 20, raising=False)
    monkeypatch.setattr(qij, "DRIVER_LIMIT", 1 << 20)  # the limit that nine million orders exceed
    row = catalogue.qij_hill(spark, str(tmp_path)).collect()[0]
    assert row["passed"] and abs(row["Vhat"] / exact(price) - 1.0) < 0.02 and row["V_lb"] <= exact(price)


@pytest.mark.parametrize("draw", ["even", "ties", "few"])
def test_units_hold_every_point(spark, tmp_path, draw):
    rng = np.random.default_rng(5)
    price = rng.uniform(2000.0, 90_000.0, 6000)
    if draw == "ties":
        price[:5000] = 4000.0
    if draw == "few":
        price = np.round(price, -4) + 5000.0
    df = write(spark, tmp_path, price)
    units = qij_table.Units(st.pareto_shape(1000.0), df, "o_orderkey", "o_totalprice", 64, 0)
    assert units.count.sum() == 6000 and np.allclose(units.features.sum(axis=0), [6000, np.log(price / 1000.0).sum()])
    drawn = units.contrast_sums(0, np.arange(len(units.count)))
    assert abs(drawn[:, 0].sum()) < 5 * np.sqrt(6000) and drawn[:, 1].min() < -3 and drawn[:, 2].max() > 3
    assert np.array_equal(np.sort(drawn[:, 0]), np.sort(units.contrast_sums(0, np.arange(len(units.count)))[:, 0]))
    r = qij_table.run(st.pareto_shape(1000.0), df, "o_orderkey", "o_totalprice", units=64)
    assert abs(r.v_hat[0] / exact(price) - 1.0) < 0.03


def test_a_value_that_is_missing(spark, tmp_path):
    df = write(spark, tmp_path, [2000.0, 3000.0, float("nan")])
    with pytest.raises(RuntimeError):
        qij_table.run(st.pareto_shape(1000.0), df, "o_orderkey", "o_totalprice")
