"""The certified method on a table of any size, for algebraic statistics of one column.

The points stay in the table. They are cut by value into some two thousand units, and the model of the influences is constant on each: the
interpolant through units at their mean values, with weights that are sums over their points. Cells and leaves are sets of units. What is
measured is not coarser: an evaluation at a mean takes every point of its units, and a test's contrast has its own Gaussian weight for each point, so
that its misfit has the whole variance of psi about the model, also that inside units, and the limit U holds for all points. Units that are too coarse
for eps fail the test; the method then begins anew with four times as many.

Passes: the moments, the cuts, the units' sums, and one for each test. A task turns its Arrow batches into one row for each unit; one groupBy adds
them. The driver holds the units and what the interpolant needs for them, whatever the number of points.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.evaluate import forward_step
from varloom.operators.interpolant import SPAN_TOL, Span
from varloom.operators.qij import Field, Leaves, Result, Run, Vector, Verdict, examine, report
from varloom.operators.quantize import pilot_budget, shared_boundary_scales
from varloom.operators.statistics import Algebraic

#: Units by rank, and as many by width, at first and at most; rows of the sample that places the cuts by rank, for each of them.
UNITS, MOST, EACH = 1024, 16384, 4


def normals(h: np.ndarray) -> np.ndarray:
    """Standard normals from 64-bit hashes (Box and Muller)."""
    h = h.view(np.uint64)
    u = ((h >> np.uint64(32)).astype(float) + 0.5) / 2.0**32
    return np.sqrt(-2.0 * np.log(u)) * np.cos((h & np.uint64(0xFFFFFFFF)).astype(float) * (2.0 * np.pi / 2.0**32))


class Units:
    """The points by unit: number, mean value in deviations, sums of the statistic's features."""

    def __init__(self, T: Algebraic, df: DataFrame, key: str, x: str, units: int, seed: int):
        self.T, self.seed = T, seed
        self.rows = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"))
        self.passes = 0
        m = self.rows.agg(F.count("*"), F.count(F.when(F.abs("x") < F.lit(math.inf), 1)), F.avg("x"), F.stddev_pop("x"), F.min("x"), F.max("x")).first()
        if not m[0] or m[1] < m[0]:
            raise RuntimeError("the fit at unit weights failed: no point, or one without a finite value")
        self.n, mean, spread = int(m[0]), float(m[2]), float(m[3]) or 1.0
        # Cuts by rank come from rows of least hash; they only say where units end, and every row is in one.
        first = self.rows.select("x", self._hash("cuts").alias("h")).orderBy("h", "x").limit(EACH * units).collect()
        some = np.sort([r["x"] for r in first])[EACH - 1 :: EACH]
        self.cuts = np.unique(np.concatenate([some, np.linspace(m[4], m[5], units + 1)[1:-1]]))
        sums = self.summed(None)
        self.kept = np.flatnonzero(sums[:, 0])  # places between cuts that hold points
        sums = sums[self.kept]
        self.count, self.features, self.low, self.high = sums[:, 0], sums[:, 4:], sums[:, 2], sums[:, 3]
        self.x = (sums[:, 1] / self.count - mean) / spread
        self.width = (self.high - self.low) / spread

    def _hash(self, *what):
        return F.xxhash64(F.lit(self.seed), *[F.lit(v) for v in what], "k", "x")

    def summed(self, draw: int | None, drawn: np.ndarray | None = None) -> np.ndarray:
        """By place: number, sum of values, least and largest value, and the features' sums. With draw, the number of a test, each point has its normal as
        its weight, least and largest are those of the weights, and only the places in drawn count."""
        self.passes += 1
        T, cuts, k, places = self.T, self.cuts, len(self.T.columns(["x"])), len(self.cuts) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, low, high = np.zeros((places, 2 + k)), np.full(places, np.inf), np.full(places, -np.inf)
            for batch in batches:
                x = batch.column(0).to_numpy()
                at = np.searchsorted(cuts, x)
                v = None
                if draw is not None:
                    own = drawn[at]
                    x, at, v = x[own], at[own], normals(batch.column(1).to_numpy()[own])
                if not len(x):
                    continue
                out[:, 0] += np.bincount(at, minlength=places)
                out[:, 1] += np.bincount(at, x if v is None else v, places)
                for j, f in enumerate(T.prepare(x).T):
                    out[:, 2 + j] += np.bincount(at, f if v is None else f * v, places)
                np.minimum.at(low, at, x if v is None else v)
                np.maximum.at(high, at, x if v is None else v)
            some = np.flatnonzero(out[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(low[some]), pa.array(high[some]), *[pa.array(c) for c in out[some].T]], names=["u", "low", "high", *[f"s{j}" for j in range(2 + k)]])

        rows = self.rows.select("x", F.lit(0).cast("long").alias("h") if draw is None else self._hash("test", draw).alias("h"))
        parts = rows.mapInArrow(run, "u long, low double, high double, " + ", ".join(f"s{j} double" for j in range(2 + k)))
        out = np.zeros((places, 4 + k))
        for r in parts.groupBy("u").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(2 + k)]).collect():
            out[r["u"]] = [r["s0"], r["s1"], r["low"], r["high"], *[r[f"s{j}"] for j in range(2, 2 + k)]]
        return out

    def contrast_sums(self, draw: int, which: np.ndarray) -> np.ndarray:
        """By unit, of those in which: sum of the points' normals, least, largest, and the features' sums under them."""
        drawn = np.zeros(len(self.cuts) + 1, dtype=bool)
        drawn[self.kept[which]] = True
        return self.summed(draw, drawn)[self.kept][:, 1:]


class UnitEvaluator:
    """Evaluations at vectors over units, whose weights are sums over the units' points, all of one weight."""

    def __init__(self, units: Units):
        self.units, self.T, self.n = units, units.T, units.n
        self.measured = list(range(len(self.T.outputs)))
        self.eta = float(self.T.eta)
        self.delta = forward_step(self.eta)
        self.total = units.features.sum(axis=0)
        self.base = self.T.of_sums(self.total)[0]
        if not np.isfinite(self.base).all():
            raise RuntimeError("the fit at unit weights failed")
        self.base_evaluations, self.made = 1, 0
        self.mean = units.features / units.count[:, None]

    def __call__(self, us: Sequence[Vector]) -> np.ndarray:
        if not us:
            return np.zeros((0, len(self.measured)))
        count = self.units.count
        sums = np.array([w @ self.mean[i] for i, w in us])
        total = np.array([float(np.sum(w)) for _, w in us])
        largest = [max(float(np.abs(self.n * w / count[i] - t).max()), abs(t) if len(i) < len(count) else 0.0) for (i, w), t in zip(us, total, strict=True)]
        return self.at(sums, total, np.array(largest))

    def at(self, sums: np.ndarray, total: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """From the features' sums under each vector, its own sum, and its largest |n u - sum u|."""
        self.made += len(sums)
        t = self.delta / largest
        fits = self.T.of_sums((1.0 - t * total)[:, None] * self.total + (t * self.n)[:, None] * sums)
        if not np.isfinite(fits).all():
            raise RuntimeError(f"{int((~np.isfinite(fits)).any(axis=1).sum())} of {len(fits)} evaluations failed")
        return (fits - self.base) / t[:, None]


class UnitSpan(Span):
    """As Span, among functions that are constant on units, a unit's coordinate its weight over the root of its number."""

    def __init__(self, label: np.ndarray, count: np.ndarray):
        super().__init__(label, np.bincount(label))
        self.root, self.all = np.sqrt(count), np.bincount(label, count)

    def residual(self, index: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.zeros(len(self.root))
        r[index] = weight / self.root[index]
        return np.arange(len(r)), r - (np.bincount(self.label[index], weight, len(self.all)) / self.all)[self.label] * self.root

    def test(self, index: np.ndarray, weight: np.ndarray) -> tuple[bool, float, tuple]:
        scaled = weight / self.root[index]
        if not np.any(scaled):  # a contrast inside one unit
            return True, 0.0, ()
        _, _, (at, r, x, left) = super().test(index, weight)
        share = max(left, 0.0) / float(scaled @ scaled)
        return share <= SPAN_TOL, share, (at, r, x, left)


class UnitField(Field):
    def __init__(self, units: Units, label: np.ndarray, scale: np.ndarray):
        super().__init__(len(label), label, np.bincount(label), units.x[:, None], scale)
        self.span = UnitSpan(label, units.count)

    def determined(self, groups: Sequence[np.ndarray], of: np.ndarray) -> np.ndarray:
        """Units are open inside."""
        return np.zeros(len(groups), dtype=bool)


class UnitLeaves(Leaves):
    """Leaves of units; sizes and means are of their points."""

    count: np.ndarray

    def number(self, points: np.ndarray) -> int:
        return int(self.count[points].sum())

    def mean_of(self, points: np.ndarray) -> Vector:
        return points, self.count[points] / self.count[points].sum()

    def product_with(self, f: np.ndarray) -> Vector:
        return np.arange(len(f)), f * self.count / self.count.sum()

    def mean_square(self, psi: np.ndarray) -> np.ndarray:
        return self.count @ psi**2 / self.count.sum()

    def spread(self, psi: np.ndarray) -> np.ndarray:
        k, columns = len(self.points), []
        n = np.bincount(self.label, self.count, k)
        for v in psi.T:
            centre = np.bincount(self.label, self.count * v, k) / n
            columns.append(np.bincount(self.label, self.count * (v - centre[self.label]) ** 2, k) / self.count.sum())
        return np.column_stack(columns)

    def divisible(self) -> np.ndarray:
        return np.array([len(p) > 1 for p in self.points]) & ~np.array(self.whole)

    def halves(self, l: int, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """two_means() with units as heavy as their points."""
        index = self.points[l]
        rows, n = psi[index], self.count[index][:, None]
        centred = rows - (n * rows).sum(axis=0) / n.sum()
        if not np.any(centred):
            return None
        side, last = centred @ np.linalg.eigh((n * centred).T @ centred)[1][:, -1] > 0, np.inf
        while side.any() and not side.all():
            a, b = ((n[s] * centred[s]).sum(axis=0) / n[s].sum() for s in (side, ~side))
            da, db = ((centred - a) ** 2).sum(axis=1), ((centred - b) ** 2).sum(axis=1)
            moved, spread = np.where(side, da <= db, da < db), float(n[:, 0] @ np.minimum(da, db))
            if (moved == side).all() or spread >= last:
                break
            side, last = moved, spread
        if side.all() or not side.any():
            return None
        return tuple(sorted((index[side], index[~side]), key=lambda p: (self.number(p), p[0])))


class UnitRun(Run):
    def test(self) -> Verdict:
        """One pass draws a normal for each point of the leaves that have no contrast yet."""
        leaves, units, evaluate = self.leaves, self.evaluate.units, self.evaluate
        new = [l for l, n in enumerate(leaves.size) if n > 1 and leaves.contrast[l] is None]
        if new:
            sums = units.contrast_sums(len(self.rounds), np.concatenate([leaves.points[l] for l in new]))
            vectors, features, largest = [], [], []
            for l in new:
                points, n = leaves.points[l], float(leaves.number(leaves.points[l]))
                own = sums[points]
                mean = own[:, 0].sum() / n
                weight = (own[:, 0] - mean * units.count[points]) / n if len(points) > 1 else np.zeros(1)
                vectors.append((points, weight))
                features.append((own[:, 3:].sum(axis=0) - mean * units.features[points].sum(axis=0)) / n)
                largest.append(units.n / n * max(own[:, 2].max() - mean, mean - own[:, 1].min()))
            self.spent["tests"] += len(new)
            got = evaluate.at(np.array(features), np.zeros(len(new)), np.array(largest)) / self.scale
            self.model.retire([])
            for l, v, y in zip(new, vectors, got, strict=True):
                leaves.contrast[l] = self.model.offer(v, y)
            self.model.settle()
        self.verdict = examine(self.model, leaves, self.eps, self.alpha)
        return self.verdict


def cells_of(units: Units, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the units and a scale for each unit: Lloyd's iteration, units as heavy as their points, from seeds with the density of the best
    quantizer, the cube root of the points' density."""
    width = np.maximum(units.width, 1e-12 * max(float(units.width.max()), 1e-300))
    mass = np.cumsum(np.cbrt(units.count * width**2))
    seeds = np.unique(np.searchsorted(mass, (np.arange(m) + 0.5) / m * mass[-1]))
    centre, label = units.x[np.minimum(seeds, len(mass) - 1)], None
    for _ in range(300):
        new = np.searchsorted(0.5 * (centre[1:] + centre[:-1]), units.x)
        _, new = np.unique(new, return_inverse=True)
        if label is not None and np.array_equal(new, label):
            break
        label = new
        centre = np.bincount(label, units.count * units.x) / np.bincount(label, units.count)
    return label, shared_boundary_scales(units.x[:, None], centre[:, None], count=units.count)[label]


def run(T: Algebraic, df: DataFrame, key: str, x: str, *, eps: float = 0.01, level: float = 0.84, k: int = 16, seed: int = 0, units: int = UNITS) -> Result:
    """The method on all rows of a table. key: a column that tells rows apart; rows alike in both share their contrasts' weights."""
    if not 0.0 < 1.0 - level <= 0.5 or k < 1:
        raise ValueError("level must be in [0.5, 1) and k at least 1")
    while True:
        result, coarse = attempt(Units(T, df, key, x, units, seed), eps, level, k)
        if result.passed or units >= MOST or not coarse:
            return result
        units *= 4


def attempt(units: Units, eps: float, level: float, k: int) -> tuple[Result, bool]:
    """A run on units; whether finer ones could do more."""
    clock = [time.perf_counter()] * 2
    evaluate = UnitEvaluator(units)
    outputs = [str(o) for o in units.T.outputs]
    q = len(outputs)
    label, scale = cells_of(units, pilot_budget(eps, 1, q))
    clock.append(time.perf_counter())
    size = np.bincount(label, units.count)
    share, points = size / units.n, [np.flatnonzero(label == c) for c in range(len(size))]
    vectors = [(p, units.count[p] / units.count[p].sum()) for p in points]
    measured = evaluate(vectors)
    clock.append(time.perf_counter())
    s = np.sqrt(np.maximum((share[:, None] * measured**2).sum(axis=0), 1e-300))
    own_bound = np.full(q, np.sqrt(evaluate.eta))
    model = UnitField(units, label, scale)
    root = [(model.constrain(v, y), float(w)) for v, y, w in zip(vectors, measured / s, share, strict=True)]
    leaves = UnitLeaves.root(len(label), (share[:, None] * measured / s).sum(axis=0), own_bound.copy())
    leaves.count = units.count
    spent = dict(base=1, pilot=len(size), splits=0, tests=0, repairs=0, report=q)
    state = UnitRun(evaluate, model, leaves, s, own_bound, root, eps, 1.0 - level, k, np.random.RandomState(units.seed), spent)
    while state.advance(None):
        pass
    return report(state, outputs, len(size), clock), bool((units.width > 0).any())
