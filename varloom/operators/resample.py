"""Bootstrap: refits under resampled weights.

bootstrap() draws multinomial counts from one stream, replicate by replicate, so that the result does not depend on the number of
tasks; algebraic statistics then need one matrix product for each block of replicates. poisson_bootstrap() is the form for tables of any
size: each row's weight in each replicate is a Poisson variable that its own key determines, all replicates are one groupBy with partial
sums on the map side, and nothing but sums leaves a task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.evaluate import call, measure_eta
from varloom.operators.intervals import bc_interval, bca_interval, normal_interval, percentile_interval
from varloom.operators.statistics import Algebraic


@dataclass
class BootstrapResult:
    theta: np.ndarray
    replicates: np.ndarray
    status: list[str]
    outputs: tuple[str, ...]
    eta: float

    @property
    def n_degenerate(self) -> int:
        return int(np.isnan(self.replicates).any(axis=1).sum())

    def variance(self) -> np.ndarray:
        """Sample variance over the replicates that did not fail."""
        return np.array([np.var(c[~np.isnan(c)], ddof=1) if (~np.isnan(c)).sum() > 1 else np.nan for c in self.replicates.T])

    def interval(self, kind: str = "percentile", level: float = 0.95, acceleration: np.ndarray | None = None) -> np.ndarray:
        if kind == "normal":
            return normal_interval(self.theta, self.variance(), level)
        if kind == "bc":
            return bc_interval(self.replicates, self.theta, level)
        if kind == "bca":
            return bca_interval(self.replicates, self.theta, acceleration, level)
        return percentile_interval(self.replicates, level)


#: Rows of counts in one matrix product: always as many, so that a replicate is rounded alike whatever block it was drawn in.
TILE = 64


def products(counts: np.ndarray, prep: np.ndarray, first: int) -> np.ndarray:
    """counts @ prep, replicate first + k at place (first + k) % TILE of its product."""
    out = np.empty((len(counts), prep.shape[1]))
    tile, at = np.zeros((TILE, counts.shape[1])), 0
    while at < len(counts):
        place = (first + at) % TILE
        n = min(TILE - place, len(counts) - at)
        tile[:] = 0.0
        tile[place : place + n] = counts[at : at + n]
        out[at : at + n] = (tile @ prep)[place : place + n]
        at += n
    return out


def bootstrap(T, x: np.ndarray, b: int, seed: int = 0, spark: SparkSession | None = None, block: int = 64) -> BootstrapResult:
    n = len(x)
    rng = np.random.default_rng(seed)
    prep = T.prepare(x) if hasattr(T, "prepare") else None
    theta = call(T, x, np.ones(n), None, T.eta, prep)
    eta = measure_eta(T, x, theta)[0] if np.isfinite(theta).all() else float(T.eta)
    out, p = np.empty((b, len(T.outputs))), np.full(n, 1.0 / n)
    for at in range(0, b, block):
        counts = rng.multinomial(n, p, size=min(block, b - at))
        if isinstance(T, Algebraic):
            out[at : at + len(counts)] = T.of_sums(products(counts, prep, at))
        elif spark is None:
            out[at : at + len(counts)] = [call(T, x, w.astype(float), theta, eta, prep) for w in counts]
        else:
            out[at : at + len(counts)] = _refit_block(spark, T, x, counts, theta, eta)
    status = ["nan" if np.isnan(r).any() else "ok" for r in out]
    return BootstrapResult(theta, out, status, tuple(T.outputs), eta)


def _refit_block(spark: SparkSession, T, x: np.ndarray, counts: np.ndarray, theta: np.ndarray, eta: float) -> np.ndarray:
    import pandas as pd

    shared = spark.sparkContext.broadcast((T, x, theta, eta))

    def run(frames):
        stat, points, start, tol = shared.value
        prep = stat.prepare(points) if hasattr(stat, "prepare") else None
        for pdf in frames:
            yield pd.DataFrame([(k, call(stat, points, np.asarray(w, dtype=float), start, tol, prep).tolist()) for k, w in zip(pdf["k"], pdf["w"], strict=True)], columns=["k", "t"])

    rows = [(k, w.tolist()) for k, w in enumerate(counts)]
    df = spark.createDataFrame(rows, "k int, w array<long>").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
    got = {r["k"]: r["t"] for r in df.mapInPandas(run, "k int, t array<double>").collect()}
    return np.array([got[k] for k in range(len(rows))], dtype=float)


#: Where the law of a Poisson(1) variable steps up.
STEPS = list(itertools.accumulate(math.exp(-1.0) / math.factorial(k) for k in range(18)))


def uniform(key: Column | str, replicate: Column, seed: int = 0) -> Column:
    """In [0, 1), from a hash of key and replicate."""
    return F.pmod(F.xxhash64(F.lit(seed), replicate, F.col(key) if isinstance(key, str) else key), F.lit(2**52)) / F.lit(float(2**52))


def poisson_quantile(u: Column) -> Column:
    """The Poisson(1) variable at a uniform, to 1e-16: two comparisons on average."""
    out = F.when(u < F.lit(STEPS[0]), 0)
    for k, t in enumerate(STEPS[1:], 1):
        out = out.when(u < F.lit(t), k)
    return out.otherwise(len(STEPS))


def poisson_weight(key: Column | str, replicate: Column, seed: int = 0) -> Column:
    """A Poisson(1) variable that key and replicate determine."""
    return poisson_quantile(uniform(key, replicate, seed))


def replicated(T: Algebraic, df: DataFrame, x: Sequence[str], weight: Callable[[Column], Column], b: int, by: Sequence[str] = (), of: Callable[[Column], Column] | None = None) -> DataFrame:
    """b and the outputs of b replicates, for each group. weight: a row's weight in a replicate, or what of() makes its weight from, computed
    once. A row meets its replicates one after the other in one generated loop with a single weight in it, its features made before; sums by
    group and replicate are made where the row is, and what is shuffled is one row of sums for each task, group and replicate."""
    names = [f"_f{i}" for i, _ in enumerate(T.columns(x))]
    rows = df.withColumns(dict(zip(names, T.columns(x), strict=True))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    w = F.col("_w")
    drawn = rows.withColumn("_w", weight(F.col("_b")))
    weighted = (drawn if of is None else drawn.withColumn("_w", of(w))).withColumn("_w", w.cast("double"))
    sums = weighted.groupBy(*by, F.col("_b").alias("b")).agg(F.count("*").alias("_n"), *[F.sum(w * F.col(n)).alias(f"_s{i}") for i, n in enumerate(names)])
    return T.solved(sums, [*by, "b"])


def poisson_bootstrap(T: Algebraic, df: DataFrame, x: Sequence[str], key: str, b: int, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """b and the outputs of b replicates, for each group, with weights that key and replicate determine."""
    return replicated(T, df, x, lambda n: uniform(key, n, seed), b, by, poisson_quantile)


def counted_bootstrap(T: Algebraic, df: DataFrame, x: Sequence[str], counts: DataFrame, key: str) -> DataFrame:
    """Replicates from a table of counts (b, key, cnt): one equi-join, one aggregation."""
    return T.by(df.join(counts, key).withColumn("_w", F.col("cnt").cast("double")), x, ["b"], "_w")
