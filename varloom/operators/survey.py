"""The survey of a quantized data set: prototypes as weighted data, their influences, a check of the step, and refinement.

A cell's prototype is the mean of its points, with the share of their weight. An evaluation moves a share t of all weight onto one prototype;
the influence of the cell is the forward difference along t, less the mean over cells whose evaluation did not fail, by mass. Cells are a
DataFrame and so are the evaluations, a row for each. Algebraic statistics need the totals and the cell's own features; any other is refitted on
the prototypes, which are broadcast within a checked size, one evaluation a row.

Refinement splits units until the total mismatch between points and prototypes, under a loss, is halved. Each round ranks the units by
mismatch in classes, cuts all of the highest classes that together could bring the half, and cuts them by two-means side by side: a round of
two-means is one sum by unit and side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.evaluate import POINTS_LIMIT, call
from varloom.operators.statistics import Algebraic

#: Cells on which the step is doubled.
LARGEST = 5
#: Classes of mismatch by factors of two: their number in each factor.
CLASSES = 4


def prototypes(points: DataFrame, cell: str, x: Sequence[str], weight: Column | None = None) -> DataFrame:
    """cell, p (its share of the weight) and the means of x: one aggregation. Points without a cell count as none."""
    w = F.lit(1.0) if weight is None else weight
    own = points.filter(F.col(cell).isNotNull()).groupBy(cell).agg(F.sum(w).alias("_w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in x])
    total = own.agg(F.sum("_w").alias("_all"))
    return own.crossJoin(F.broadcast(total)).select(cell, (F.col("_w") / F.col("_all")).alias("p"), *x)


def responses(stat, cells: DataFrame, cell: str, x: Sequence[str], delta: float | Sequence[float], start: np.ndarray | None = None) -> DataFrame:
    """cell, p, t and the outputs: T with a share t of all weight moved onto the cell, less T before, divided by t. delta: the step, or several;
    then a row for each, and the number of the step as `step`. A failure is NaN."""
    deltas = [delta] if isinstance(delta, float) else list(delta)
    rows = cells.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(float(d)).alias("delta")) for k, d in enumerate(deltas)])))
    t = F.when(F.col("p") < 1.0, F.col("_d.delta") * F.col("p") / (1.0 - F.col("p"))).otherwise(F.lit(None).cast("double"))
    rows = rows.select(cell, "p", F.col("_d.step").alias("step"), t.alias("t"), *x)
    kind, names = cells.schema[cell].dataType.simpleString(), stat.outputs
    schema = f"`{cell}` {kind}, p double, step int, t double, " + ", ".join(f"`{o}` double" for o in names)
    if isinstance(stat, Algebraic):
        features = stat.columns(x)
        totals = cells.agg(*[F.sum(F.col("p") * f).alias(f"_t{i}") for i, f in enumerate(features)])
        moved = rows.crossJoin(F.broadcast(totals)).select(cell, "p", "step", "t", *[f.alias(f"_s{i}") for i, f in enumerate(features)], *[f"_t{i}" for i in range(len(features))])
        of_sums, k = stat.of_sums, len(features)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                t = pdf["t"].to_numpy(dtype=float)[:, None]
                own, base = (pdf[[f"_{n}{i}" for i in range(k)]].to_numpy(dtype=float) for n in "st")
                d = (of_sums((1.0 - t) * base + t * own) - of_sums(base)) / t if len(pdf) else np.empty((0, len(names)))
                yield pd.concat([pdf[[cell, "p", "step", "t"]], pd.DataFrame(d, columns=list(names), index=pdf.index)], axis=1)

        return moved.mapInPandas(run, schema)
    return _refitted(stat, cells, rows, cell, x, start, schema)


def _refitted(stat, cells: DataFrame, rows: DataFrame, cell: str, x: Sequence[str], start: np.ndarray | None, schema: str) -> DataFrame:
    size = cells.count() * 8 * (len(x) + 1)
    if size > POINTS_LIMIT:
        raise ValueError(f"{size} bytes of prototypes: beyond the limit of a refit task")
    pdf = cells.orderBy(cell).toPandas()
    points, p, keys = pdf[list(x)].to_numpy(dtype=float), pdf["p"].to_numpy(dtype=float), pdf[cell].tolist()
    n = len(keys)
    theta = call(stat, points, n * p, start, stat.eta)
    shared = cells.sparkSession.sparkContext.broadcast((stat, points, n * p, theta, {k: i for i, k in enumerate(keys)}))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        T, at, base, begun, place = shared.value
        prep = T.prepare(at) if hasattr(T, "prepare") else None
        for f in frames:
            out = []
            for k, t in zip(f[cell], f["t"], strict=True):
                w = (1.0 - t) * base
                w[place[k]] += t * base.sum()
                out.append((call(T, at, w, begun, T.eta, prep) - begun) / t)
            yield pd.concat([f[[cell, "p", "step", "t"]], pd.DataFrame(np.array(out).reshape(len(f), -1), columns=list(T.outputs), index=f.index)], axis=1)

    return rows.repartition(max(1, min(n, cells.sparkSession.sparkContext.defaultParallelism)), cell).mapInPandas(run, schema)


def centred(rows: DataFrame, p: str, outputs: Sequence[str]) -> DataFrame:
    """The outputs less their means by mass over the rows where they are finite."""
    ok = {o: F.col(f"`{o}`").isNotNull() & (F.abs(F.col(f"`{o}`")) < F.lit(math.inf)) for o in outputs}
    means = rows.agg(*[(F.sum(F.when(ok[o], F.col(p) * F.col(f"`{o}`"))) / F.sum(F.when(ok[o], F.col(p)))).alias(f"_mean_{o}") for o in outputs])
    return rows.crossJoin(F.broadcast(means)).select(*[(F.col(f"`{c}`") - F.col(f"`_mean_{c}`")).alias(c) if c in outputs else F.col(f"`{c}`") for c in rows.columns])


def prototype_influences(stat, cells: DataFrame, cell: str, x: Sequence[str], delta: float, start: np.ndarray | None = None) -> DataFrame:
    """cell, p and the influence of each on every output, centred by mass."""
    got = responses(stat, cells, cell, x, float(delta), start).select(cell, "p", *[F.col(f"`{o}`") for o in stat.outputs])
    return centred(got, "p", stat.outputs)


def step_doubling(stat, cells: DataFrame, cell: str, x: Sequence[str], delta: float, start: np.ndarray | None = None, largest: int = LARGEST) -> DataFrame:
    """Of the cells of largest mass: how the raw response grows when the step is doubled, near 2 where T is smooth. Equal masses by cell."""
    some = cells.orderBy(F.col("p").desc(), cell).limit(largest).select(cell)
    # T is that of all cells; only the rows of some are evaluated.
    got = responses(stat, cells, cell, x, [delta, 2.0 * delta], start).join(F.broadcast(some), cell)
    raw = [(F.col("t") * F.col(f"`{o}`")).alias(o) for o in stat.outputs]
    wide = got.select(cell, "p", "step", *raw).groupBy(cell, "p").agg(*[F.max(F.when(F.col("step") == k, F.col(f"`{o}`"))).alias(f"_{k}_{o}") for o in stat.outputs for k in (0, 1)])
    return wide.select(cell, "p", *[(F.col(f"`_1_{o}`") / F.col(f"`_0_{o}`")).alias(o) for o in stat.outputs])


# Two-means and refinement -----------------------------------------------------------------------------------------------------------


def two_means(points: DataFrame, unit: str, x: Sequence[str], units: DataFrame | None = None, side: str = "side", tolerance: float = 1e-12) -> tuple[DataFrame, int]:
    """points with side (true or false; null in units that can't be cut, because their points are equal or one side stays empty), and the rounds
    taken. units: the units to cut, all without it. First the sides of the leading axis through the mean, then those nearer to either
    side's mean, until no mean moves. A point as near to one as to the other is on the first's side. The state is two means a unit, sums by
    (unit, side) of one pass each; points keep their place."""
    own = points if units is None else points.join(units.select(unit), unit, "left_semi")
    own = own.filter(F.col(unit).isNotNull())
    d = len(x)
    first = own.groupBy(unit).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)])
    means = {r[unit]: np.array([r[f"m{i}"] for i in range(d)]) for r in first.collect()}  # a row for each unit
    state = _table(points.sparkSession, own, unit, [(k, *m) for k, m in means.items()], [f"_m{i}" for i in range(d)])
    c = [F.col(v) - F.col(f"_m{i}") for i, v in enumerate(x)]
    moments = own.join(state, unit).groupBy(unit).agg(*[F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]).collect()
    centres = {}
    for r in moments:
        s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
        if not np.any(s):
            continue
        axis = np.linalg.eigh(s)[1][:, -1]
        axis = axis * (1.0 if axis[np.argmax(np.abs(axis))] > 0 else -1.0)
        centres[r[unit]] = (means[r[unit]], axis)
    rule = _table(points.sparkSession, own, unit, [(k, *m, *v) for k, (m, v) in centres.items()], [f"_{n}{i}" for n in "ab" for i in range(d)])
    above = sum(((F.col(v) - F.col(f"_a{i}")) * F.col(f"_b{i}") for i, v in enumerate(x)), F.lit(0.0)) > 0.0
    rounds = 0
    while True:
        rounds += 1
        sums = own.join(rule, unit).groupBy(unit, above.alias("side")).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).collect()
        now: dict = {}
        for r in sums:
            now.setdefault(r[unit], {})[r["side"]] = np.array([r[f"m{i}"] for i in range(d)])
        now = {k: (v[True], v[False]) for k, v in now.items() if len(v) == 2}
        moved = rounds == 1 or now.keys() != centres.keys() or any(np.abs(np.concatenate(now[k]) - np.concatenate(centres[k])).max() > tolerance * max(1.0, np.abs(np.concatenate(now[k])).max()) for k in now)
        centres = now
        rule = _table(points.sparkSession, own, unit, [(k, *a, *b) for k, (a, b) in centres.items()], [f"_{n}{i}" for n in "ab" for i in range(d)])
        square = lambda n: sum(((F.col(v) - F.col(f"_{n}{i}")) * (F.col(v) - F.col(f"_{n}{i}")) for i, v in enumerate(x)), F.lit(0.0))
        above = square("a") <= square("b")
        if not moved:
            break
    labelled = points.join(rule, unit, "left").withColumn(side, F.when(F.col("_a0").isNotNull(), above))
    return labelled.select(*points.columns, side), rounds


def _table(spark: SparkSession, like: DataFrame, unit: str, rows: list[tuple], names: Sequence[str]) -> DataFrame:
    kind = like.schema[unit].dataType.simpleString()
    return spark.createDataFrame([tuple(v if k == 0 else float(v) for k, v in enumerate(r)) for r in rows], f"`{unit}` {kind}, " + ", ".join(f"{n} double" for n in names))


def mismatches(points: DataFrame, unit: str, x: Sequence[str], loss: Callable[[Sequence[Column]], Column]) -> DataFrame:
    """unit, n and delta: the points' loss less n times that of their mean; 0 for one point."""
    own = points.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("*").alias("n"), F.sum(loss([F.col(c) for c in x])).alias("_l"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)])
    at_mean = loss([F.col(f"_m{i}") for i in range(len(x))])
    return own.select(unit, "n", F.when(F.col("n") > 1, F.col("_l") - F.col("n") * at_mean).otherwise(0.0).alias("delta"))


def to_cut(units: DataFrame, unit: str, goal: float) -> DataFrame:
    """The units of the highest classes of |delta| whose sum exceeds its excess over goal: the fewest that could bring it there, whatever they
    leave. Classes are by powers of two; one aggregation of at most a few hundred rows decides."""
    size = F.abs("delta")
    level = F.floor(F.log2(size) * CLASSES)
    rows = units.filter(size > 0).groupBy(level.alias("level")).agg(F.sum(size).alias("s")).orderBy(F.col("level").desc()).collect()
    total, need, cut = sum(r["s"] for r in rows), 0.0, None
    for r in rows:
        need, cut = need + r["s"], r["level"]
        if total - need <= goal:
            break
    return units.filter(size > 0).filter(level >= F.lit(cut)).select(unit) if cut is not None else units.limit(0).select(unit)


def refine(points: DataFrame, unit: str, x: Sequence[str], loss: Callable[[Sequence[Column]], Column], keep: Callable[[DataFrame], DataFrame], share: float = 0.5, rounds: int = 64) -> tuple[DataFrame, list[float]]:
    """points with finer units (whole numbers; a cut unit u keeps one side, the other gets a new number), and the total of |delta| at the begin and
    after each round, until share of the first is reached or no unit can be cut. keep: writes a table where lineage ends (checkpoint() on a
    cluster), so that each round starts from stored rows."""
    now = keep(points)
    total = lambda df: float(mismatches(df, unit, x, loss).agg(F.coalesce(F.sum(F.abs("delta")), F.lit(0.0))).first()[0])
    totals, closed = [total(now)], None
    for _ in range(rounds):
        if totals[-1] <= share * totals[0] or totals[0] == 0.0:
            break
        units = mismatches(now, unit, x, loss)
        if closed is not None:  # units that could not be cut
            units = units.join(closed, unit, "left_anti")
        chosen = to_cut(units, unit, share * totals[0])
        cut, _ = two_means(now, unit, x, chosen, "_side")
        width = now.agg(F.max(unit)).first()[0] + 1
        cut = keep(cut.withColumn("_new", F.when(F.col("_side") == F.lit(False), F.col(unit) + F.lit(width)).otherwise(F.col(unit)).cast(points.schema[unit].dataType)))
        stuck = chosen.join(cut.filter(F.col("_side").isNotNull()).select(unit).distinct(), unit, "left_anti")
        closed = keep(stuck if closed is None else closed.unionByName(stuck))
        parents = cut.filter(F.col("_side").isNotNull()).select(F.col(unit).alias("_u"), F.col("_new").alias(unit), *x)
        # A cut that does not lower its unit's mismatch is taken back, so that the total never rises.
        children = mismatches(parents, unit, x, loss).join(parents.select("_u", unit).distinct(), unit).groupBy("_u").agg(F.sum(F.abs("delta")).alias("_after"))
        worse = children.join(units.select(F.col(unit).alias("_u"), F.abs("delta").alias("_before")), "_u").filter("_after >= _before").select("_u")
        worse = keep(worse)
        closed = keep(closed.unionByName(worse.select(F.col("_u").alias(unit))))
        back = cut.join(worse.withColumn("_back", F.lit(True)), F.col(unit) == F.col("_u"), "left")
        now = keep(back.withColumn(unit, F.when(F.col("_back").isNull(), F.col("_new")).otherwise(F.col(unit))).select(*points.columns))
        totals.append(total(now))
        if totals[-1] == totals[-2] and not chosen.join(closed, unit, "left_anti").head(1) and not units.join(closed, unit, "left_anti").filter("delta != 0").head(1):
            break
    return now, totals


def stored(df: DataFrame) -> DataFrame:
    """df by checkpoint() in the folder of spark.checkpoint.dir; one is made only where that is unset and the master is local, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="varloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


