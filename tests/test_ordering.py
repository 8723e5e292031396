import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import ordering
from varloom.operators import statistics as st
from varloom.operators.resample import poisson_weight, replicated


def test_buckets_count_the_cuts(spark):
    df = spark.createDataFrame([(float(k),) for k in range(-3, 12)], "x double")
    for cuts in ([], [2.0], [0.0, 1.0, 5.0, 7.0]):
        for r in df.select("x", ordering.bucket(F.col("x"), cuts).alias("b")).collect():
            assert r["b"] == sum(r["x"] > c for c in cuts)


@pytest.mark.parametrize("buckets", [1, 2, 7, 64])
def test_ranks(spark, buckets):
    rng = random.Random(buckets)
    values = [rng.choice([1, 2, 2**40, -5]) if rng.random() < 0.5 else rng.randrange(10**6) for _ in range(2000)]
    got = ordering.ranked(spark.createDataFrame([(v,) for v in values], "v long"), "v", "place", buckets).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(2000)) and [r["v"] for r in got] == sorted(values)
    assert ordering.ranked(spark.createDataFrame([], "v long"), "v", "place").count() == 0


@pytest.mark.parametrize("accuracy", [10, 100, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.873, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, accuracy, q):
    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    groups = {"a": rng.standard_normal(3000), "b": rng.integers(0, 3, 500).astype(float), "c": np.array([7.0]), None: rng.pareto(1.0, 50)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double").repartition(5)
    got = {r["g"]: r["quantile"] for r in ordering.exact_quantile(df, "v", q, ["g"]).collect()}
    assert got == {g: pytest.approx(np.quantile(x, q), rel=1e-12) for g, x in groups.items()}
    one = ordering.exact_quantile(df, "v", q).first()["quantile"]
    assert one == pytest.approx(np.quantile(np.concatenate(list(groups.values())), q), rel=1e-12)


@pytest.mark.parametrize("block", [1, 2, 5, 1 << 20])
def test_islands(spark, block):
    rng = random.Random(block)
    rows = [(g, k) for g in "ab" for k in rng.sample(range(-60, 200), 150)] + [("c", k) for k in range(40)] + [("a", 500), ("a", 500), ("d", None)]
    got = sorted(tuple(r) for r in ordering.islands(spark.createDataFrame(rows, "g string, k long"), "k", ["g"], block).select("g", "first", "last", "n").collect())
    want = []
    for g in "abc":
        own = sorted({k for h, k in rows if h == g})
        at = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1] + 1), len(own)]
        want += [(g, own[a], own[b - 1], b - a) for a, b in zip(at, at[1:])]
    assert got == want


@pytest.mark.parametrize("b", [1, 24, 25, 26, 60])
def test_replicates_side_by_side(spark, b):
    T = st.pareto_shape(1.0)
    df = spark.range(300).select("id", (F.lit(1.0) + F.rand(3)).alias("x"), (F.col("id") % 2).alias("g"))
    df = spark.createDataFrame(df.collect(), df.schema)
    weight = lambda n: poisson_weight("id", n, 5).cast("double")
    got = {(r["g"], r["b"]): r["alpha"] for r in replicated(T, df, ["x"], weight, b, ["g"]).collect()}
    each = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    want = {(r["g"], r["b"]): r["alpha"] for r in T.by(each.withColumn("_w", weight(F.col("b"))), ["x"], ["g", "b"], "_w").collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()} and len(got) == 2 * b
