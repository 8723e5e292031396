"""Mixtures fitted to a table: every pass of EM, of the information and of the search's scores is one aggregation.

A task turns its Arrow batches into partial sums by the same NumPy functions that serve points in memory, and gives one row for each entry of
the sums; `groupBy(entry).sum` adds the tasks' rows, a few thousand numbers each, whatever the number of points. What reaches the driver is
of the size of the mixtures: n, x, y, xx, xy, yy by component, or the packed upper triangle of the information matrix. A race of twenty
starts is one such pass a round, its starts side by side.

Points are two columns and, if given, a weight; a row of which one is null, NaN or infinite, or whose weight is not positive, counts as none. Nothing is cached: a lost executor's tasks
read their part of the table again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from varloom.operators import mixture_search as search
from varloom.operators.mixture import Data, Mixture, Parameters, basis, candidate_sums, em_sums, finished, from_free, log_density, log_parts, louis, move_sums, penalty_curvature, penalty_gradient, stepped

#: Points that a task works on at once.
ROWS = 8192
#: The summary's grid: squares on a side, and how many deviations it reaches out.
SIDE, REACH = 160, 5.0


class TableData:
    """A table as an engine of the search. total, cov and a as of points in memory."""

    def __init__(self, df: DataFrame, x: Column | str, y: Column | str, weight: Column | str | None = None):
        c = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
        points = df.select(c(x).alias("x"), c(y).alias("y"), (F.lit(1.0) if weight is None else c(weight)).alias("w"))
        finite = [F.abs(v) < F.lit(math.inf) for v in ("x", "y", "w")]
        self.points = points.filter((F.col("w") > 0) & finite[0] & finite[1] & finite[2])
        w, px, py = F.col("w"), F.col("x"), F.col("y")
        centre = self.points.agg(F.sum("w"), F.sum(w * px), F.sum(w * py), F.count("*")).first()
        if not centre[0]:
            raise ValueError("no point has a weight")
        self.total, self.n = float(centre[0]), int(centre[3])
        self.centre = np.array([centre[1], centre[2]], dtype=float) / self.total
        dx, dy = px - float(self.centre[0]), py - float(self.centre[1])
        s = self.points.agg(F.sum(w * dx * dx), F.sum(w * dx * dy), F.sum(w * dy * dy)).first()
        self.cov = np.array([[s[0], s[1]], [s[1], s[2]]], dtype=float) / self.total
        self.a = 1.0 / self.total
        #: Passes over the table so far.
        self.passes = 0

    penalty = Data.penalty

    def summed(self, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over the table of part(points, basis, weights), an array of numbers of fixed size."""
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x, y, w = (batch.column(k).slice(at, ROWS).to_numpy() for k in range(3))
                    points = np.column_stack([x, y])
                    got = np.asarray(part(points, basis(x), w), dtype=float).ravel()
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

        rows = self.points.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(rows))
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    def em_all(self, starts: Sequence[Parameters]) -> list[tuple[Parameters, float]]:
        """One step for each of many mixtures, in one pass."""
        starts = list(starts)

        def part(x, phi, w):
            got = [em_sums(x, phi, w, p) for p in starts]
            return np.concatenate([np.concatenate([[v], s.ravel()]) for v, s in got])

        sums, at, out = self.summed(part), 0, []
        for p in starts:
            width = 6 if p.thread is None else 15
            value, own = sums[at], sums[at + 1 : at + 1 + len(p.w) * width].reshape(len(p.w), width)
            at += 1 + own.size
            out.append((stepped(own, p, self), float(value) + self.penalty(p)))
        return out

    def em(self, p: Parameters) -> tuple[Parameters, float]:
        return self.em_all([p])[0]

    def log_likelihood(self, p: Parameters) -> float:
        return float(self.summed(lambda x, phi, w: np.array([w @ log_density(log_parts(x, phi, p))]))[0]) + self.penalty(p)

    def information(self, u: np.ndarray, k: int, thread: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised log likelihood, its gradient and its Hessian: a matrix of sums over points, its upper triangle packed."""
        p, size = from_free(u, k, thread), len(u)
        upper = np.triu_indices(size)

        def part(x, phi, w):
            value, slope, h = louis(x, phi, w, p)
            return np.concatenate([[value], slope, h[upper]])

        sums = self.summed(part)
        h = np.zeros((size, size))
        h[upper] = sums[1 + size :]
        h += h.T - np.diag(np.diag(h))
        return float(sums[0]) + self.penalty(p), sums[1 : 1 + size] + penalty_gradient(self, u, k, thread), h + penalty_curvature(self, u, k, thread)

    def against(self, p: Parameters) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        def of(share, mean, cov):
            got = self.summed(lambda x, phi, w: candidate_sums(x, phi, w, log_density(log_parts(x, phi, p)), share, mean, cov))
            return got.reshape(len(share), 7)

        return of

    def move_scores(self, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
        names = ("rr", "r", "rlr", "rlf", "f")

        def part(x, phi, w):
            got = move_sums(x, phi, p)
            return np.concatenate([got[n].ravel() for n in names])

        sums, k = self.summed(part), p.k
        parts = np.split(sums, np.cumsum([k * k, k, k, k]))
        return search.of_sums({"rr": parts[0].reshape(k, k), **dict(zip(names[1:], parts[1:], strict=True))})


def grid(data: TableData, side: int, reach: float) -> GroupedData:
    """The points by the squares of a grid that reaches out to `reach` deviations, points beyond in its border."""
    place = lambda c, at, s: F.least(F.greatest(F.floor((F.col(c) - float(at)) / float(s) * (side / (2 * reach)) + side / 2), F.lit(0)), F.lit(side - 1))
    sd = np.sqrt(np.maximum(np.diag(data.cov), 1e-300))
    return data.points.groupBy(place("x", data.centre[0], sd[0]).alias("i"), place("y", data.centre[1], sd[1]).alias("j"))


def square_sums(data: TableData) -> list[Column]:
    w, x, y = F.col("w"), F.col("x") - float(data.centre[0]), F.col("y") - float(data.centre[1])
    return [F.sum(w * v).alias(n) for n, v in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y))]


class GridCells:
    """Cells of a table as candidates for a new component: the squares of a grid that reaches out to `reach` deviations, points beyond in its
    border. One aggregation, at most side * side rows."""

    def __init__(self, data: TableData, side: int = 12, reach: float = 3.0, least: int = 5):
        rows = grid(data, side, reach).agg(F.count("*").alias("c"), *square_sums(data)).filter(F.col("c") >= least).orderBy("i", "j").collect()
        s = np.array([[r[k] for k in ("n", "x", "y", "xx", "xy", "yy")] for r in rows], dtype=float).reshape(-1, 6)
        n = s[:, 0]
        mean = s[:, 1:3] / n[:, None]
        c11, c12, c22 = s[:, 3] / n - mean[:, 0] ** 2, s[:, 4] / n - mean[:, 0] * mean[:, 1], s[:, 5] / n - mean[:, 1] ** 2
        floor = 1e-4 * float(np.trace(data.cov))
        self.share, self.mean = n / data.total, mean + data.centre
        self.cov = np.stack([np.column_stack([c11 + floor, c12]), np.column_stack([c12, c22 + floor])], axis=1)


class Summary:
    """A table as the squares of a fine grid, each with its points' number, mean and covariance: one aggregation, at most SIDE * SIDE rows. An engine
    in memory, on which starts find their way before they are finished on the table. A square's points share their responsibilities, from the mean
    of their log densities, as in the greedy EM of Verbeek, Nunnink and Vlassis (2006); its own covariance keeps components from shrinking onto it."""

    penalty = Data.penalty

    def __init__(self, data: TableData, side: int = SIDE, reach: float = REACH):
        rows = grid(data, side, reach).agg(*square_sums(data)).orderBy("i", "j").collect()
        s = np.array([[r[k] for k in ("n", "x", "y", "xx", "xy", "yy")] for r in rows], dtype=float)
        self.w, mean = s[:, 0], s[:, 1:3] / s[:, :1]
        self.inner = s[:, 3:6] / s[:, :1] - np.column_stack([mean[:, 0] ** 2, mean[:, 0] * mean[:, 1], mean[:, 1] ** 2])
        self.inner[:, [0, 2]] = np.maximum(self.inner[:, [0, 2]], 0.0)
        self.x = mean + data.centre
        self.phi, self.total, self.cov, self.a, self.centre = basis(self.x[:, 0]), data.total, data.cov, data.a, data.centre
        raw = np.column_stack([self.x[:, 0] ** 2, self.x[:, 0] * self.x[:, 1], self.x[:, 1] ** 2]) + self.inner
        self.terms = np.column_stack([np.ones(len(self.x)), self.x, raw])

    def parts(self, p: Parameters) -> np.ndarray:
        """The mean over each square's points of the log of weight times density."""
        det = p.cov[:, 0, 0] * p.cov[:, 1, 1] - p.cov[:, 0, 1] ** 2
        inverse = np.array([p.cov[:, 1, 1], -2.0 * p.cov[:, 0, 1], p.cov[:, 0, 0]]) / det
        return log_parts(self.x, self.phi, p) - 0.5 * self.inner @ inverse

    def em_all(self, starts: Sequence[Parameters]) -> list[tuple[Parameters, float]]:
        out = []
        for p in starts:
            parts = self.parts(p)
            f = log_density(parts)
            r = np.exp(parts - f[:, None]) * self.w[:, None]
            out.append((stepped(r.T @ self.terms, p, self), float(self.w @ f) + self.penalty(p)))
        return out

    def against(self, p: Parameters) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        frozen = log_density(self.parts(p))[:, None]

        def of(share, mean, cov):
            own = self.parts(Parameters(share, mean, cov))
            both = np.logaddexp(own, frozen + np.log1p(-share))
            r = np.exp(own - both) * self.w[:, None]
            return np.column_stack([self.w @ (both - frozen), r.T @ self.terms])

        return of


def sampled_starts(data: TableData, k: int, starts: int, seed: int = 0) -> list[Parameters]:
    """Starts whose means are points of the table, those of least hash: k for each, of equal weights, all with a share of the whole
    covariance. One pass, k * starts rows."""
    key = F.xxhash64(F.lit(seed), "x", "y", "w")
    rows = data.points.select("x", "y", key.alias("h")).distinct().orderBy("h", "x", "y").limit(k * starts).collect()
    at = np.array([[r["x"], r["y"]] for r in rows], dtype=float).reshape(-1, 2)
    cov = np.tile(data.cov / k + 1e-6 * np.trace(data.cov) * np.eye(2), (k, 1, 1))
    return [Parameters(np.full(k, 1.0 / k), at[s * k : s * k + k], cov.copy()) for s in range(len(at) // k)]


def distinct(rested: list[tuple[Parameters, float]], cov: np.ndarray, tol: float = 1e-3) -> list[Parameters]:
    """Best first, those that are not at the place of a better one: by weights, and by means and covariances in the data's deviations."""
    sd = np.sqrt(np.diag(cov))
    out: list[tuple[np.ndarray, Parameters]] = []
    for p, _ in sorted(rested, key=lambda v: -v[1]):
        q = p.permuted(np.lexsort((p.mean[:, 1], p.mean[:, 0])))
        at = np.concatenate([q.w, (q.mean / sd).ravel(), (q.cov / np.outer(sd, sd)).ravel()])
        if all(np.abs(at - other).max() > tol for other, _ in out):
            out.append((at, p))
    return [p for _, p in out]


def fit(df: DataFrame, x: Column | str, y: Column | str, k: int, weight: Column | str | None = None, start: Parameters | None = None, starts: int = 20, seed: int = 0, eta: float = 1e-10) -> tuple[Parameters, float, str]:
    """k Gaussians fitted to a table: from a start, or cold. Then the beginnings are one by insertion on a grid's cells, its tighter and wider
    variants, and sampled ones; all go to rest on the table's summary, and the places they come to are finished on the table by Newton steps,
    but for those that a bound (search.limit, on the table) excludes; split and merge moves follow. Mixture (components by mean), penalised
    log likelihood, status."""
    data = TableData(df, x, y, weight)
    return fit_engine(data, k, start, starts, seed, eta)


def fit_engine(data: TableData, k: int, start: Parameters | None = None, starts: int = 20, seed: int = 0, eta: float = 1e-10) -> tuple[Parameters, float, str]:
    if start is None:
        summary = Summary(data)
        begun = search.greedy(summary, Parameters(np.ones(1), data.centre[None], data.cov[None].copy()), k, GridCells(data))
        beginnings = ([begun, *search.variants(begun)] if begun is not None else []) + sampled_starts(data, k, starts, seed)
        rested = [search.accelerated(summary, p, 1e-10, 300) for p in beginnings if p.feasible()]
        best = None
        for p in distinct([(q, v) for q, v in rested if q.feasible() and math.isfinite(v)], data.cov):
            if best is None or search.limit(data, p) >= best[1]:
                got = finished(data, p, 1e-9)[:2]
                best = got if best is None or got[1] > best[1] else best
        if best is None:
            raise ValueError("no start is feasible")
        start, value = best
        if k >= 3:
            start, value = search.split_merge(data, start, value, 1e-9, full=lambda q: finished(data, q, 1e-9)[:2])[:2]
    p, value, status = finished(data, start, eta)
    return Mixture(k).labelled(p), value, status


