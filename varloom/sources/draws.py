"""Draws: generated data sets by name, size and seed, the catalogue of cases, and adapters of tables.

draw() gives a NumPy array; the Spark data source "varloom_draw" gives the same points as rows (i, x array<double>), and with a range of
draws as rows (s, i, x), each draw made in the task that reads it, so that data never crosses the driver. The seed of draw s is seed + s
in every method: products of different methods join on s.

The populations of the fundamental plane and of the stellar masses are not public here; they are synthesized: a Gaussian with a thin
axis, and the mass law itself at the values below.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varloom.operators import mixture as mx
from varloom.operators import statistics as st

#: The true mass law (m_c, sigma, x), and the plane's coefficients and scatter.
MASS_TRUTH = (0.22088, 0.43360, 1.02125)
PLANE_TRUTH = (0.44305, -1.04084, 0.0, 0.26472)


def rotated(a: float, b: float, degrees: float) -> np.ndarray:
    """Covariance of an ellipse with semi-axes a and b."""
    t = math.radians(degrees)
    r = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
    return r @ np.diag([a * a, b * b]) @ r.T


#: Fixed values of the cloud populations: semi-axes, angle in degrees, centre.
CLOUD = (2.0, 1.2, 30.0, (0.0, 0.0))
CORES = ((0.05, 0.025, 20.0, (0.0, 0.0)), (0.05, 0.025, -50.0, (1.32, 0.55)), (0.05, 0.025, 70.0, (-1.2, -1.1)))
CORE_SHARES = (0.02, 0.01, 0.005)
CLOUD_SHARE, THREAD_SHARE = 0.585, 0.38
#: The filament: mean and variance along x, coefficients of (1, sin, cos), variance across; and the beads that stand on it.
THREAD = dict(m=0.0, s2x=1.5625, b=(0.0, 0.55, 0.0), s2p=0.0064)
#: Beads: places t on the curve (2.2 t, 0.55 sin(pi t / 1.2)), semi-axes along and across it.
BEADS, BEAD = (-1.0, -0.6, -0.2, 0.2, 0.6, 1.0), (0.35, 0.08)


def cloud_components(beads: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances: the cloud, the beads (if they make the thread), the cores."""
    parts = [(CLOUD_SHARE, CLOUD[3], rotated(*CLOUD[:3]))]
    if beads:
        for t in BEADS:
            x = 2.2 * t
            slope = math.degrees(math.atan(THREAD["b"][1] * mx.OMEGA * math.cos(mx.OMEGA * x)))
            parts.append((THREAD_SHARE / len(BEADS), (x, THREAD["b"][1] * math.sin(mx.OMEGA * x)), rotated(*BEAD, slope)))
    parts += [(w, c[3], rotated(*c[:3])) for w, c in zip(CORE_SHARES, CORES, strict=True)]
    w, mean, cov = zip(*parts, strict=True)
    return np.array(w), np.array(mean), np.array(cov)


#: Fixed values of the nine-component mixture: weights (the last is what is left), centres, and variances, all of correlation 0.6.
MIX_WEIGHTS = (0.025, 0.3775, 0.035, 0.05, 0.025, 0.05, 0.3775, 0.035)
MIX_CENTRES = ((-2.5, -1.0), (-1.5, 0.0), (-1.5, 0.0), (-0.5, 1.0), (0.0, 0.0), (0.5, -1.0), (1.5, 0.0), (1.5, 0.0), (2.5, 1.0))
MIX_VARIANCES = (1 / 225, 4 / 9, 1 / 225, 1 / 225, 1 / 9, 1 / 225, 4 / 9, 1 / 225, 1 / 225)


def mix_components() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = np.array([*MIX_WEIGHTS, 1.0 - sum(MIX_WEIGHTS)])
    return w, np.array(MIX_CENTRES), np.array([[[v, 0.6 * v], [0.6 * v, v]] for v in MIX_VARIANCES])


def gaussians(rng: np.random.Generator, counts: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.concatenate([m + rng.standard_normal((c, 2)) @ np.linalg.cholesky(s).T for c, m, s in zip(counts, mean, cov, strict=True)])


def _pareto(n: int, rng: np.random.Generator) -> np.ndarray:
    return st.X_MIN * (1.0 - rng.random(n)) ** (-1.0 / st.ALPHA)


def _mvt(n: int, rng: np.random.Generator) -> np.ndarray:
    return rng.standard_normal((n, st.DIM)) / np.sqrt(rng.chisquare(st.NU, n) / st.NU)[:, None]


def _mix(n: int, rng: np.random.Generator) -> np.ndarray:
    w, mean, cov = mix_components()
    return gaussians(rng, rng.multinomial(n, w), mean, cov)


def _beads(n: int, rng: np.random.Generator) -> np.ndarray:
    w, mean, cov = cloud_components(True)
    return gaussians(rng, rng.multinomial(n, w), mean, cov)


def _thread(n: int, rng: np.random.Generator) -> np.ndarray:
    w, mean, cov = cloud_components(False)
    counts = rng.multinomial(n, [*w, THREAD_SHARE])
    x = THREAD["m"] + math.sqrt(THREAD["s2x"]) * rng.standard_normal(counts[-1])
    b = THREAD["b"]
    y = b[0] + b[1] * np.sin(mx.OMEGA * x) + b[2] * np.cos(mx.OMEGA * x) + math.sqrt(THREAD["s2p"]) * rng.standard_normal(counts[-1])
    return np.concatenate([gaussians(rng, counts[:-1], mean, cov), np.column_stack([x, y])])


def _plane(n: int, rng: np.random.Generator) -> np.ndarray:
    a, b, c, scatter = PLANE_TRUTH
    xy = np.column_stack([2.2 + 0.2 * rng.standard_normal(n), 2.6 + 0.4 * rng.standard_normal(n)])
    across = scatter * math.sqrt(1 + a * a + b * b) * rng.standard_normal(n) * 0.4
    return np.column_stack([xy, a * xy[:, 0] + b * xy[:, 1] + c + across])


def _masses(n: int, rng: np.random.Generator) -> np.ndarray:
    """By inversion of the law on a fine grid of log mass."""
    m_c, sigma, x = MASS_TRUTH
    u = np.linspace(math.log10(st.M_MIN), 3.0, 20_001)
    z = (u - math.log10(m_c)) / sigma
    u_b = math.log10(st.M_BREAK)
    join = math.exp(-0.5 * ((u_b - math.log10(m_c)) / sigma) ** 2)
    density = np.where(u <= u_b, np.exp(-0.5 * z * z), join * 10.0 ** (-x * (u - u_b)))
    cdf = np.concatenate([[0.0], np.cumsum(0.5 * (density[1:] + density[:-1]))])
    return 10.0 ** np.interp(rng.random(n) * cdf[-1], cdf, u)


DRAWS: dict[str, Callable[[int, np.random.Generator], np.ndarray]] = {"pareto": _pareto, "mvt": _mvt, "mix11": _mix, "cloudfil": _beads, "cloudfil_u": _thread, "fp": _plane, "imf": _masses}


def draw(name: str, n: int, seed: int) -> np.ndarray:
    if name not in DRAWS:
        raise KeyError(f"no data set {name!r}; there are {sorted(DRAWS)}")
    return DRAWS[name](n, np.random.default_rng(seed))


def resample(pool: DataFrame, n: int, seed: int, key: str = "i") -> DataFrame:
    """n rows of an indexed pool (key 0 .. size - 1) with replacement: positions equi-joined to the pool."""
    size = pool.agg(F.max(key) + 1).first()[0]
    at = F.floor(F.rand(seed) * F.lit(size)).cast("long")
    return pool.sparkSession.range(n).select(F.col("id").alias("pos"), at.alias(key)).join(pool, key)


# The data source -----------------------------------------------------------------------------------------------------------------


class DrawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.name, self.n, self.seed = options["dataset"], int(options.get("n", "10000")), int(options.get("seed", "0"))
        self.first, self.end = int(options.get("first", "0")), int(options.get("end", "1"))

    def partitions(self):
        return [InputPartition(s) for s in range(self.first, self.end)]

    def read(self, partition):
        x = draw(self.name, self.n, self.seed + partition.value)
        x = x[:, None] if x.ndim == 1 else x
        for i, row in enumerate(x.tolist()):
            yield partition.value, i, row


class DrawSource(DataSource):
    """Options: dataset, n, seed, first and end (a range of draws)."""

    @classmethod
    def name(cls) -> str:
        return "varloom_draw"

    def schema(self) -> str:
        return "s int, i long, x array<double>"

    def reader(self, schema) -> DrawReader:
        return DrawReader(self.options)


def points(spark: SparkSession, dataset: str, n: int, seed: int = 0, first: int = 0, end: int = 1) -> DataFrame:
    """s, i, x and the columns x0 .. of the array."""
    spark.dataSource.register(DrawSource)
    df = spark.read.format("varloom_draw").options(dataset=dataset, n=n, seed=seed, first=first, end=end).load()
    width = draw(dataset, 2, 0).reshape(2, -1).shape[1]
    return df.select("s", "i", "x", *[F.col("x")[k].alias(f"x{k}") for k in range(width)])


def table_points(df: DataFrame, key: str, columns: dict[str, Column | str]) -> DataFrame:
    """A table as a draw: i from a unique key, x0 .. from expressions."""
    own = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in columns.items()]
    return df.select(F.col(key).cast("long").alias("i"), *own)


def whitening(x: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Population z-scores of the columns and the way back."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    return (x - mean) / spread, lambda z: z * spread + mean


# Cases ----------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Case:
    dataset: str
    estimator: str
    make: Callable[[], object]
    truth: tuple[float, ...] | None = None
    transform: Callable[[np.ndarray], np.ndarray] | None = None

    def draw(self, n: int, seed: int) -> np.ndarray:
        return draw(self.dataset, n, seed)


def _subject(population: str, core: int) -> Callable[[], object]:
    return lambda: mx.core_statistic(population == "cloudfil_u", core)


_WHITE = lambda x: whitening(x)[0]
CASES: dict[tuple[str, str], Case] = {
    (c.dataset, c.estimator): c
    for c in (
        Case("pareto", "shape", st.pareto_shape, (2.0,)),
        Case("pareto", "tail", st.pareto_tail, (0.01,)),
        Case("pareto", "all", st.pareto_all, (2.0, 0.01)),
        Case("mvt", "nu", st.DegreesOfFreedom, (5.0,), _WHITE),
        Case("mvt", "tail", st.mvt_tail, (0.01,), _WHITE),
        Case("mvt", "all", st.MvtAll, (5.0, 0.01), _WHITE),
        Case("fp", "fp", st.fundamental_plane, PLANE_TRUTH),
        Case("imf", "Chabrier", st.MassFunction, MASS_TRUTH),
        Case("mix11", "gmm", lambda: mx.Mixture(9)),
        Case("cloudfil", "p1", _subject("cloudfil", 0)),
        Case("cloudfil", "p2", _subject("cloudfil", 1)),
        Case("cloudfil_u", "p1", _subject("cloudfil_u", 0)),
        Case("cloudfil_u", "p2", _subject("cloudfil_u", 1)),
    )
}


def case(dataset: str, estimator: str) -> Case:
    if (dataset, estimator) not in CASES:
        raise KeyError(f"no case {dataset}/{estimator}; there are {sorted(CASES)}")
    return CASES[dataset, estimator]


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(c.dataset, c.estimator, list(c.make().outputs), None if c.truth is None else list(map(float, c.truth))) for c in CASES.values()]
    return spark.createDataFrame(rows, "dataset string, estimator string, outputs array<string>, truth array<double>")


def truth(dataset: str, estimator: str) -> dict[str, float]:
    """The true value of each output: stored, or derived from the population."""
    c = case(dataset, estimator)
    T = c.make()
    if c.truth is not None:
        return dict(zip(T.outputs, map(float, c.truth), strict=True))
    if dataset == "mix11":
        return dict(zip(T.outputs, mx.theta_of(*mix_components()), strict=True))
    w, mean, cov = cloud_components(dataset == "cloudfil")
    return dict(zip(mx.DERIVED, T.true_derived(w, mean, cov), strict=True))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A truth file {estimator: {outputs, values, source}} as rows estimator, output, value, source."""
    df = spark.read.option("multiLine", True).json(path)
    each = [df.select(F.lit(e).alias("estimator"), F.posexplode(F.arrays_zip(F.col(f"`{e}`.outputs"), F.col(f"`{e}`.values"))).alias("p", "z"), F.col(f"`{e}`.source").alias("source")).select("estimator", F.col("z.outputs").alias("output"), F.col("z.values").cast("double").alias("value"), "source") for e in df.columns]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out
