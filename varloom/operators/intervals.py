"""Intervals from replicates or from a variance: percentile, bias-corrected, with acceleration, quadratic ABC, normal; and the
curvature that the ABC interval needs. The replicate forms exist on DataFrames (exact percentiles) and on arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.numerics import norm_cdf, norm_ppf


def tails(level: float) -> tuple[float, float]:
    return norm_ppf(0.5 * (1.0 - level)), norm_ppf(0.5 * (1.0 + level))


def normal_interval(theta: np.ndarray, variance: np.ndarray, level: float) -> np.ndarray:
    z = tails(level)[1]
    half = z * np.sqrt(variance)
    return np.stack([np.asarray(theta) - half, np.asarray(theta) + half], axis=-1)


def normal_columns(theta: Column | str, variance: Column | str, level: float) -> tuple[Column, Column]:
    theta = F.col(theta) if isinstance(theta, str) else theta
    half = F.lit(tails(level)[1]) * F.sqrt(variance)
    return theta - half, theta + half


def _quantiles(replicates: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = []
    for j in range(replicates.shape[1]):
        own = replicates[:, j]
        own = own[~np.isnan(own)]
        out.append([np.nan, np.nan] if not len(own) or not (0 <= low[j] <= high[j] <= 1) else np.quantile(own, [low[j], high[j]]))
    return np.array(out)


def percentile_interval(replicates: np.ndarray, level: float) -> np.ndarray:
    q = replicates.shape[1]
    return _quantiles(replicates, np.full(q, 0.5 * (1 - level)), np.full(q, 0.5 * (1 + level)))


def bias_z(replicates: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The normal quantile of the share of replicates below the estimate."""
    ok = ~np.isnan(replicates)
    share = ((replicates < np.asarray(theta)) & ok).sum(axis=0) / np.maximum(ok.sum(axis=0), 1)
    return np.array([norm_ppf(float(p)) for p in share])


def bca_interval(replicates: np.ndarray, theta: np.ndarray, acceleration: np.ndarray, level: float) -> np.ndarray:
    z0, a = bias_z(replicates, theta), np.broadcast_to(np.asarray(acceleration, dtype=float), (replicates.shape[1],))
    ends = []
    for z in tails(level):
        w = z0 + z
        ends.append(np.array([norm_cdf(float(v)) for v in z0 + w / (1.0 - a * w)]))
    return _quantiles(replicates, *ends)


def bc_interval(replicates: np.ndarray, theta: np.ndarray, level: float) -> np.ndarray:
    return bca_interval(replicates, theta, np.zeros(replicates.shape[1]), level)


def abc_interval(theta, sigma, a, b, c, level: float) -> np.ndarray:
    """Quadratic ABC endpoints (DiCiccio and Efron, 1996, equations 4.12 and 4.13) from acceleration a, bias b, curvature c."""
    theta, sigma, a, b, c = (np.asarray(v, dtype=float) for v in (theta, sigma, a, b, c))
    z0 = a + c - b / sigma
    ends = []
    for z in tails(level):
        w = z0 + z
        lam = w / (1.0 - a * w) ** 2
        ends.append(theta + sigma * (lam + c * lam * lam))
    return np.stack(ends, axis=-1)


def curvature(evaluate: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, influence: np.ndarray, mass: np.ndarray, n: float, eta: float, step_scale: float = 1.0, outputs: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ABC curvature of each output, its step, and whether it comes from one side. The weights of the groups (influence (M, q),
    mass (M,)) are multiplied by 1 +- step u, u the influences scaled to unit mean square; the second difference over step**2 is
    2 n sigma c. A group with an influence that is not finite stays unmoved and out of the mean square. If one side's fit fails, the
    other side's second difference to twice the step takes its place; if both fail, the curvature is NaN."""
    influence, mass, theta = np.asarray(influence, dtype=float), np.asarray(mass, dtype=float), np.asarray(theta, dtype=float)
    outputs = list(range(len(theta))) if outputs is None else list(outputs)
    out, steps, one_sided = np.full(len(outputs), np.nan), np.empty(len(outputs)), np.zeros(len(outputs), dtype=bool)
    for k, j in enumerate(outputs):
        ok = np.isfinite(influence[:, j])
        clean = np.where(ok, influence[:, j], 0.0)
        square = float(mass @ clean**2) / (1.0 if ok.all() else float(mass[ok].sum()) or 1.0)
        if square <= 0:
            steps[k] = np.nan
            continue
        u = clean / math.sqrt(square)
        steps[k] = h = min(eta**0.25, 0.5 / float(np.abs(u).max())) * step_scale
        at = lambda s: float(evaluate(1.0 + s * u)[j])  # noqa: B023, E731
        plus, minus = at(h), at(-h)
        if math.isfinite(plus) and math.isfinite(minus):
            second = plus - 2.0 * theta[j] + minus
        elif math.isfinite(plus) or math.isfinite(minus):
            one_sided[k] = True
            near, side = (plus, 1.0) if math.isfinite(plus) else (minus, -1.0)
            second = at(2.0 * side * h) - 2.0 * near + theta[j]
        else:
            continue
        out[k] = second / h**2 / (2.0 * n * math.sqrt(square / n))
    return out, steps, one_sided


# On DataFrames of replicates ----------------------------------------------------------------------------------------------------


def nan_to_null(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def replicate_summary(replicates: DataFrame, outputs: Sequence[str], level: float, by: Sequence[str] = ()) -> DataFrame:
    """Per output o: var_o (sample variance), lo_o and hi_o (exact percentiles, linear between), and n_degenerate, the number of
    replicates with any failed output."""
    bad = F.lit(False)
    for o in outputs:
        bad = bad | F.isnan(o) | F.col(o).isNull()
    low, high = 0.5 * (1.0 - level), 0.5 * (1.0 + level)
    aggs = [F.sum(bad.cast("long")).alias("n_degenerate")]
    for o in outputs:
        v = nan_to_null(o)
        aggs += [F.var_samp(v).alias(f"var_{o}"), F.percentile(v, F.lit(low)).alias(f"lo_{o}"), F.percentile(v, F.lit(high)).alias(f"hi_{o}")]
    return replicates.groupBy(*by).agg(*aggs)
