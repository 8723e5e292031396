"""Cells: a quantization of the points for the pilot, the scales of the cells from the boundaries they share, and cuts of leaves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.operators.ordering import ranked


def zador(r: int) -> float:
    return 2.0 * math.gamma(r / 2 + 1) ** (2 / r) * ((r + 2) / r) ** ((r + 2) / 2) / (r * (r + 2))


def pilot_budget(eps: float, d: int, q: int) -> int:
    """Cells for a relative precision eps in min(d, q) effective dimensions; independent of the number of points."""
    r = min(d, q)
    return round(3.0 * (zador(r) / eps) ** (r / 2))


def distances_sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2.0 * x @ c.T + (c**2).sum(axis=1)[None], 0.0)


def kmeans(x: np.ndarray, m: int, seed: int = 0, rounds: int = 300, block: int = 4096) -> np.ndarray:
    """Labels by Lloyd's iteration from greedy k-means++ seeds: each next seed is the best of 2 + ln m candidates drawn in proportion
    to the squared distance to the seeds so far."""
    n = len(x)
    m = min(m, n)
    rng = np.random.RandomState(seed)
    tries = 2 + int(math.log(m))
    seeds = [int(rng.randint(n))]
    near = distances_sq(x, x[seeds])[:, 0]
    for _ in range(1, m):
        total = near.sum()
        if total <= 0:
            break
        picks = np.minimum(np.searchsorted(np.cumsum(near), rng.random_sample(tries) * total), n - 1)
        options = np.minimum(near[:, None], distances_sq(x, x[picks]))
        best = int(np.argmin(options.sum(axis=0)))
        seeds.append(int(picks[best]))
        near = options[:, best]
    centres = x[seeds].copy()
    label = None
    for _ in range(rounds):
        new = np.concatenate([np.argmin(distances_sq(x[a : a + block], centres), axis=1) for a in range(0, n, block)])
        if label is not None and (new == label).all():
            break
        label = new
        size = np.bincount(label, minlength=len(centres))
        for k in range(x.shape[1]):
            centres[:, k] = np.where(size > 0, np.bincount(label, x[:, k], minlength=len(centres)) / np.maximum(size, 1), centres[:, k])
    return label


@dataclass
class Pilot:
    """Cells of the points: scaled coordinates, label, sizes, prototypes, and a kernel scale for each cell and each point."""

    x: np.ndarray
    label: np.ndarray
    size: np.ndarray
    prototype: np.ndarray
    scale: np.ndarray

    @property
    def point_scale(self) -> np.ndarray:
        return self.scale[self.label]

    def weights(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The cell means as sparse weight vectors."""
        order = np.argsort(self.label, kind="stable")
        ends = np.cumsum(self.size)
        return [(order[e - s : e], np.full(s, 1.0 / s)) for s, e in zip(self.size.tolist(), ends.tolist(), strict=True)]


def shared_boundary_scales(x: np.ndarray, prototype: np.ndarray, block: int = 4096, count: np.ndarray | None = None) -> np.ndarray:
    """For each cell the mean distance to the cells it shares a boundary with, weighted by the number of points whose two nearest
    prototypes are the pair; a cell without any takes the distance to its nearest prototype. count: how many points each row of x stands for."""
    c = len(prototype)
    if c == 1:
        return np.ones(1)
    shared = np.zeros((c, c))
    for at in range(0, len(x), block):
        two = np.argsort(distances_sq(x[at : at + block], prototype), axis=1, kind="stable")[:, :2]
        np.add.at(shared, (two[:, 0], two[:, 1]), 1.0 if count is None else count[at : at + block])
    shared += shared.T
    apart = np.sqrt(distances_sq(prototype, prototype))
    total = shared.sum(axis=1)
    np.fill_diagonal(apart, np.inf)
    nearest = apart.min(axis=1)
    np.fill_diagonal(apart, 0.0)
    out = np.where(total > 0, (shared * apart).sum(axis=1) / np.maximum(total, 1), nearest)
    return np.where(out > 0, out, np.where(nearest > 0, nearest, 1.0))


def build_cells(x: np.ndarray, m: int | None, eps: float, q: int, seed: int = 0, transform=None, cells: np.ndarray | None = None) -> Pilot:
    x = np.asarray(x, dtype=float)
    x = x[:, None] if x.ndim == 1 else x
    if transform is not None:
        z = np.asarray(transform(x), dtype=float)
    else:
        spread = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)
    label = kmeans(z, m or pilot_budget(eps, z.shape[1], q), seed) if cells is None else np.asarray(cells)
    _, label = np.unique(label, return_inverse=True)
    size = np.bincount(label)
    prototype = np.column_stack([np.bincount(label, z[:, k]) / size for k in range(z.shape[1])])
    return Pilot(z, label, size, prototype, shared_boundary_scales(z, prototype))


def two_means(rows: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Two children of a leaf by its points' values: sides of the leading principal axis first, then Lloyd moves of points strictly
    closer to the other mean. The smaller child first, of equals that with the first index; None if the leaf can't be cut."""
    centred = rows - rows.mean(axis=0)
    if not np.any(centred):
        return None
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    side, last = centred @ axis > 0, np.inf
    while True:
        if side.all() or not side.any():
            return None
        a, b = centred[side].mean(axis=0), centred[~side].mean(axis=0)
        da, db = ((centred - a) ** 2).sum(axis=1), ((centred - b) ** 2).sum(axis=1)
        moved, spread = np.where(side, da <= db, da < db), float(np.minimum(da, db).sum())
        if (moved == side).all() or spread >= last:  # moves that rounding alone makes end it too
            break
        side, last = moved, spread
    if side.all() or not side.any():
        return None
    one, two = index[side], index[~side]
    return (one, two) if (len(one), one[0]) < (len(two), two[0]) else (two, one)


# On DataFrames --------------------------------------------------------------------------------------------------------------------


def nearest_two(points: DataFrame, key: str, x: Column, prototypes: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """key, first, second and their squared distances: prototypes are a small table by contract and stand in the expression, so that
    assigning is a projection without any join."""
    def dist(p: Sequence[float]) -> Column:
        centre = F.array(*[F.lit(float(v)) for v in p])
        return F.aggregate(F.zip_with(x, centre, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)

    every = F.array_sort(F.array(*[F.struct(dist(p).alias("d"), F.lit(k).alias("cell")) for k, p in prototypes]))
    return points.select(key, every.alias("_n")).select(key, F.col("_n")[0]["cell"].alias("first"), F.col("_n")[0]["d"].alias("d1"), F.col("_n")[1]["cell"].alias("second"), F.col("_n")[1]["d"].alias("d2"))


def boundary_edges(nearest: DataFrame) -> DataFrame:
    """The symmetric counts of points between two cells: j, k, cnt."""
    pairs = nearest.groupBy(F.col("first").alias("j"), F.col("second").alias("k")).agg(F.count("*").alias("c"))
    both = pairs.unionByName(pairs.select(F.col("k").alias("j"), F.col("j").alias("k"), "c"))
    return both.groupBy("j", "k").agg(F.sum("c").alias("cnt"))


def relabelled(df: DataFrame, label: str, out: str) -> DataFrame:
    """Labels renumbered from 0 without gaps: the ranks are made over the distinct labels only, in buckets."""
    return df.join(ranked(df.select(label).distinct(), label, out), label)


def within_variance(df: DataFrame, leaf: str, values: Sequence[str], n: Column | None = None) -> DataFrame:
    """Share of the leaf times the variance inside it, for each value; n: the number of points, of the table unless given."""
    parts = df.groupBy(leaf).agg(F.count("*").alias("n"), *[F.var_pop(v).alias(f"_{v}") for v in values])
    total = F.sum("n").over(W.partitionBy()) if n is None else n
    return parts.select(leaf, "n", *[(F.col("n") * F.col(f"_{v}") / total).alias(f"within_{v}") for v in values])
