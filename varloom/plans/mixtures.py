"""Queries that fit mixtures to a table: EM in rounds, a whole fit, split and merge scores, the information matrix.

The points are the events: the logarithms of value and of user, each plus one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import mixture_search as search
from varloom.operators import table_mixture as tm
from varloom.operators.mixture import Parameters, to_free
from varloom.plans.catalogue import query, rounded, table

POINTS = "pts AS (SELECT ln(value + 1) AS x, ln(user_id + 1) AS y FROM events)"
#: Sums that the penalty leans on: number, mean and covariance of all points.
BASE = f"""{POINTS}, centre AS (SELECT count(*)::DOUBLE AS nn, avg(x) AS ax, avg(y) AS ay FROM pts),
base AS (SELECT nn, ax, ay, 1 / nn AS a, sxx, sxy, syy FROM centre, (SELECT avg((x - ax) * (x - ax)) AS sxx, avg((x - ax) * (y - ay)) AS sxy, avg((y - ay) * (y - ay)) AS syy FROM pts, centre))"""
#: Two components half a deviation below and above the mean, of the whole covariance.
_START = ", ".join(f"0.5::DOUBLE AS w{k}, ax {s} 0.5 * sqrt(sxx) AS mx{k}, ay {s} 0.5 * sqrt(syy) AS my{k}, sxx AS p{k}, sxy AS q{k}, syy AS r{k}" for k, s in enumerate("-+"))
NAMES = [f"{n}{k}" for k in range(2) for n in ("w", "mx", "my", "p", "q", "r")]


def _density(k: int) -> str:
    d = f"(p{k} * r{k} - q{k} * q{k})"
    return f"w{k} / (2 * pi() * sqrt({d})) * exp(-0.5 * (r{k} * (x - mx{k}) * (x - mx{k}) - 2 * q{k} * (x - mx{k}) * (y - my{k}) + p{k} * (y - my{k}) * (y - my{k})) / {d})"


def _sums(k: int) -> str:
    r = f"f{k} / (f0 + f1)"
    return ", ".join(f"sum({r} * {v}) AS {n}{k}_" for n, v in (("n", "1"), ("x", "x"), ("y", "y"), ("xx", "x * x"), ("xy", "x * y"), ("yy", "y * y")))


def _moved(k: int) -> str:
    n, a = f"n{k}_", "2 * a"
    raw = {"p": (f"xx{k}_", f"x{k}_", f"x{k}_", "sxx"), "q": (f"xy{k}_", f"x{k}_", f"y{k}_", "sxy"), "r": (f"yy{k}_", f"y{k}_", f"y{k}_", "syy")}
    cov = ", ".join(f"({v} - {i} * {j} / {n} + {a} * {s}) / ({n} + {a}) AS {c}{k}" for c, (v, i, j, s) in raw.items())
    return f"{n} / nn AS w{k}, x{k}_ / {n} AS mx{k}, y{k}_ / {n} AS my{k}, {cov}"


def _penalty(k: int) -> str:
    d = f"(p{k} * r{k} - q{k} * q{k})"
    return f"((sxx * r{k} - 2 * sxy * q{k} + syy * p{k}) / {d} + ln({d}))"


#: From mixtures (it and NAMES) to their next ones, with the penalised log likelihood before.
def _round(of: str, where: str = "TRUE") -> str:
    kept = ", ".join(f"any_value({n}) AS {n}" for n in [*NAMES, "nn", "a", "sxx", "sxy", "syy"])
    points = f"SELECT c.*, x, y, {_density(0)} AS f0, {_density(1)} AS f1 FROM (SELECT * FROM {of}, base WHERE {where}) AS c, pts"
    sums = f"SELECT it, {kept}, {_sums(0)}, {_sums(1)}, sum(ln(f0 + f1)) AS ll FROM ({points}) GROUP BY it"
    return f"SELECT it + 1 AS it, {_moved(0)}, {_moved(1)}, ll - a * ({_penalty(0)} + {_penalty(1)}) AS loglik FROM ({sums})"


def _rows(of: str, digits: int, *more: str) -> str:
    each = lambda k: f"SELECT {', '.join([*more, f'{k} AS k'])}, " + ", ".join(f"round({n}{k}, {digits}) AS {c}" for n, c in (("w", "w"), ("mx", "mx"), ("my", "my"), ("p", "c11"), ("q", "c12"), ("r", "c22"))) + f", round(loglik, 4) AS loglik FROM {of}"
    return f"{each(0)} UNION ALL {each(1)}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", F.log(F.col("value") + 1).alias("x"), F.log(F.col("user_id") + 1.0).alias("y"))


def two(data: tm.TableData) -> Parameters:
    sd = np.sqrt(np.diag(data.cov))
    return Parameters(np.full(2, 0.5), np.array([data.centre - 0.5 * sd, data.centre + 0.5 * sd]), np.tile(data.cov, (2, 1, 1)))


def as_rows(spark: SparkSession, fits: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(*head, k, float(p.w[k]), *map(float, p.mean[k]), float(p.cov[k, 0, 0]), float(p.cov[k, 0, 1]), float(p.cov[k, 1, 1]), float(v)) for head, p, v in fits for k in range(p.k)], schema)


COLUMNS = "k int, w double, mx double, my double, c11 double, c12 double, c22 double, loglik double"


@query(f"WITH {BASE}, r0 AS (SELECT 0 AS it, {_START} FROM base), r1 AS ({_round('r0')}), r2 AS ({_round('r1')}), r3 AS ({_round('r2')}) " + " UNION ALL ".join(_rows(f"r{t}", 7, "it AS round") for t in (1, 2, 3)))
def em_rounds(spark, sf_dir):
    """Three rounds of EM over all events, each one aggregation, with the log likelihood before it."""
    data = tm.TableData(events(spark, sf_dir), "x", "y")
    p, fits = two(data), []
    for t in (1, 2, 3):
        p, value = data.em(p)
        fits.append(((t,), p, value))
    return rounded(as_rows(spark, fits, f"round int, {COLUMNS}"), 7, loglik=4)


@query(f"WITH RECURSIVE {BASE}, em AS (SELECT 0 AS it, {_START}, 0.0::DOUBLE AS loglik FROM base UNION ALL {_round('em', 'it < 600')}) " + _rows("(SELECT * FROM em WHERE it = 600)", 4))
def em_fit(spark, sf_dir):
    """The same start followed to its optimum by accelerated EM and Newton steps; the SQL takes 600 plain steps."""
    data = tm.TableData(events(spark, sf_dir), "x", "y")
    p, _ = search.accelerated(data, two(data), 1e-8, 60)
    p, value, _ = tm.finished(data, p, 1e-12)
    return rounded(as_rows(spark, [((), p, data.log_likelihood(p))], COLUMNS), 4, loglik=4)


@query()
def em_cold(spark, sf_dir):
    """Two components without a start: insertion, race and Newton steps, each a pass over all events."""
    data = tm.TableData(events(spark, sf_dir), "x", "y")
    p, value, _ = tm.fit_engine(data, 2, starts=8)
    return as_rows(spark, [((), p, value)], COLUMNS)


#: Three fixed components: weight, mean, variances, covariance.
THREE = ((0.3, 2.6, 3.2, 1.6, 0.3, 0.1), (0.4, 3.8, 4.1, 0.5, 0.4, -0.05), (0.3, 3.4, 4.8, 0.8, 0.2, 0.0))


def three() -> Parameters:
    return Parameters(np.array([c[0] for c in THREE]), np.array([c[1:3] for c in THREE]), np.array([[[c[3], c[5]], [c[5], c[4]]] for c in THREE]))


def _fixed(k: int) -> str:
    w, mx, my, p, r, q = (repr(float(v)) + "::DOUBLE" for v in THREE[k])
    d = f"({p} * {r} - {q} * {q})"
    return f"1 / (2 * pi() * sqrt({d})) * exp(-0.5 * ({r} * (x - {mx}) * (x - {mx}) - 2 * {q} * (x - {mx}) * (y - {my}) + {p} * (y - {my}) * (y - {my})) / {d})"


_R3 = f"{POINTS}, f AS (SELECT {', '.join(f'{_fixed(k)} AS f{k}' for k in range(3))} FROM pts), r AS (SELECT *, {', '.join(f'{THREE[k][0]} * f{k} / ({" + ".join(f"{THREE[j][0]} * f{j}" for j in range(3))}) AS r{k}' for k in range(3))} FROM f)"


@query(
    f"WITH {_R3} " + " UNION ALL ".join(
        [f"SELECT 'merge' AS move, {i} AS i, {j} AS j, round(sum(r{i} * r{j}) / sqrt(sum(r{i} * r{i}) * sum(r{j} * r{j})), 8) AS score FROM r" for i in range(3) for j in range(i + 1, 3)]
        + [f"SELECT 'split' AS move, {k} AS i, {k} AS j, round((sum(CASE WHEN r{k} > 0 THEN r{k} * ln(r{k}) ELSE 0 END) - sum(CASE WHEN r{k} > 0 THEN r{k} * ln(f{k}) ELSE 0 END)) / sum(r{k}) - ln(sum(r{k})) + ln(sum(f{k})), 8) AS score FROM r" for k in range(3)]
    )
)
def move_scores(spark, sf_dir):
    """How alike pairs of components are, and how badly each fits its own points."""
    merge, split = tm.TableData(events(spark, sf_dir), "x", "y").move_scores(three())
    rows = [("merge", i, j, float(merge[i, j])) for i in range(3) for j in range(i + 1, 3)] + [("split", k, k, float(split[k])) for k in range(3)]
    return rounded(spark.createDataFrame(rows, "move string, i int, j int, score double"), 8)


#: Two round components; the block of the first's logit and of its mean in x.
ROUND = ((0.6, 3.0, 3.7, 1.2), (0.4, 4.2, 4.6, 0.8))
_G = [f"{w} / {v} * exp(-0.5 * ((x - {a}) * (x - {a}) + (y - {b}) * (y - {b})) / {v})" for w, a, b, v in ROUND]


@query(
    f"WITH {POINTS}, g AS (SELECT x, {_G[0]} AS g0, {_G[1]} AS g1 FROM pts), s AS (SELECT g0 / (g0 + g1) AS r, (x - {ROUND[0][1]}) / {ROUND[0][3]} AS t FROM g) "
    "SELECT round(sum(r - 0.6), 6) AS g1, round(sum(r * t), 6) AS g2, round(sum(r * 0.4 * 0.4 + (1 - r) * 0.6 * 0.6 - 0.6 * 0.4 - (r - 0.6) * (r - 0.6)), 6) AS h11, "
    f"round(sum(r * 0.4 * t - (r - 0.6) * r * t), 6) AS h12, round(sum(r * t * t - r * r * t * t - r / {ROUND[0][3]}), 6) AS h22 FROM s"
)
def louis_block(spark, sf_dir):
    """Two rows and columns of the information matrix and their entries of the gradient, from the one aggregation that makes all."""
    data = tm.TableData(events(spark, sf_dir), "x", "y")
    p = Parameters(np.array([c[0] for c in ROUND]), np.array([c[1:3] for c in ROUND]), np.array([c[3] * np.eye(2) for c in ROUND]))
    _, g, h = data.information(to_free(p), 2, False)
    return rounded(spark.createDataFrame([tuple(float(v) for v in (g[0], g[1], h[0, 0], h[0, 1], h[1, 1]))], "g1 double, g2 double, h11 double, h12 double, h22 double"), 6)


