"""Element-wise functions of the statistics as Column expressions, for DataFrames and, by expr(), for SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The wave number of the sheared basis.
OMEGA = math.pi / 2.64


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _continued(f, x: Column | str) -> Column:
    """A logarithm as in IEEE arithmetic, NumPy and SQL: minus infinity at zero and NaN below, where Spark's is null; null stays null."""
    x = col(x)
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(f(x))


def ln(x: Column | str) -> Column:
    return _continued(F.log, x)


def log10(x: Column | str) -> Column:
    return _continued(F.log10, x)


def log_ratio(x: Column | str, x_min: float) -> Column:
    return ln(col(x) / F.lit(float(x_min)))


def tail_indicator(x: Column | str, c: float) -> Column:
    return F.when(col(x) > F.lit(float(c)), 1.0).otherwise(0.0)


def radius_sq(x: Column | str) -> Column:
    """Sum of squares of an array's elements."""
    return F.aggregate(col(x), F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))


def sheared_basis(x: Column | str, omega: float = OMEGA) -> Column:
    return F.array(F.lit(1.0), F.sin(F.lit(omega) * col(x)), F.cos(F.lit(omega) * col(x)))


def unsheared(x: Column | str, y: Column | str, b: list[float], omega: float = OMEGA) -> Column:
    """y less the fitted sine wave at x."""
    return col(y) - (F.lit(b[0]) + F.lit(b[1]) * F.sin(F.lit(omega) * col(x)) + F.lit(b[2]) * F.cos(F.lit(omega) * col(x)))


def quadratic_features(x: Column | str, y: Column | str) -> Column:
    x, y = col(x), col(y)
    return F.array(x, y, x * x, x * y, y * y, F.lit(1.0))


def wrap_periodic(d: Column | str, period: float) -> Column:
    """A difference of a quantity of that period, in [-period / 2, period / 2)."""
    half = 0.5 * period
    return F.pmod(col(d) + F.lit(half), F.lit(float(period))) - F.lit(half)


def angle_branch(a: Column | str, low: float) -> Column:
    """The representative of an angle modulo pi in [low, low + pi)."""
    return F.pmod(col(a) - F.lit(low), F.lit(math.pi)) + F.lit(low)


def log_sum_exp(x: Column | str) -> Column:
    x = col(x)
    top = F.array_max(x)
    total = top + F.log(F.aggregate(x, F.lit(0.0), lambda a, b: a + F.exp(b - top)))
    return F.when(top == F.lit(-math.inf), top).otherwise(total)  # no term at all


def softmax(x: Column | str) -> Column:
    x = col(x)
    total = log_sum_exp(x)
    return F.transform(x, lambda v: F.exp(v - total))


def round_up_pow10(x: Column | str) -> Column:
    """The least power of ten at or above x; what is not positive and finite stays."""
    x = col(x)
    finite = (x > 0) & (x < F.lit(math.inf))
    return F.when(finite, F.pow(F.lit(10.0), F.ceil(F.log10(x) - F.lit(1e-9)))).otherwise(x)


def at_bound(value: Column | str, low: float, high: float, tol: float = 1e-4) -> Column:
    """Whether a value lies within a share of the box's width of one of its ends."""
    margin = tol * (high - low)
    return (F.abs(col(value) - F.lit(low)) <= margin) | (F.abs(col(value) - F.lit(high)) <= margin)


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def fit_status(outputs: list[Column | str], own: Column | None = None, failed: Column | None = None) -> Column:
    """'exception' before the statistic's own status before 'nan' before 'ok'."""
    ok = finite(outputs[0])
    for o in outputs[1:]:
        ok = ok & finite(o)
    out = F.when(~ok, "nan").otherwise("ok")
    if own is not None:
        out = F.coalesce(own, out)
    return F.when(failed, "exception").otherwise(out) if failed is not None else out


def standardized(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """df with each column's population z-score; mean and deviation by one aggregate row, joined by broadcast."""
    stats = df.agg(*[F.avg(c).alias(f"_{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"_{c}_s") for c in columns])
    out = df.join(F.broadcast(stats))
    return out.withColumns({f"{c}{suffix}": (F.col(c) - F.col(f"_{c}_m")) / F.col(f"_{c}_s") for c in columns}).drop(*stats.columns)


def unstandardized(df: DataFrame, columns: list[str], moments: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({c: F.col(f"{c}{suffix}") * F.lit(moments[c][1]) + F.lit(moments[c][0]) for c in columns})
