"""Weighted statistics T(X, w) -> theta.

Weights are non-negative and sum to the number of points. A statistic never raises: a failed fit is NaN in all its outputs. Two
kinds carry the library:

* Algebraic statistics depend on the data through a fixed set of weighted sums S = sum w f(x), theta = g(S). Their features f are
  Column expressions, so that one groupBy gives the statistic of every group, replicate or perturbed weight vector at once.
* Any object with outputs, eta and a call (X, w) on NumPy arrays is a statistic too; it runs as vectorised Python tasks.

influence() gives psi_i = N dT/dw_i, whose mean square is N times the variance of the estimate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.expressions import log10, log_ratio, radius_sq, tail_indicator
from varloom.functions.numerics import brent, digamma, f_ppf

EPS = float(np.finfo(float).eps)


def statistic(outputs: Sequence[str], eta: float, name: str | None = None) -> Callable:
    """Marks a function (X, w) as a statistic."""

    def mark(f):
        f.outputs, f.eta, f.name = tuple(outputs), float(eta), name or f.__name__
        return f

    return mark


class Algebraic:
    """theta = g(S), S the weighted sums of the features; the first feature is the constant 1."""

    takes_start = False

    def __init__(self, name: str, outputs: Sequence[str], features: Callable[[np.ndarray], np.ndarray], columns: Callable[[Sequence[str]], list[Column]], solve: Callable[[np.ndarray], np.ndarray], influence: Callable | None = None, eta: float = EPS):
        self.name, self.outputs, self.eta = name, tuple(outputs), eta
        self.features, self.columns, self.solve, self._influence = features, columns, solve, influence

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return self.features(np.asarray(x, dtype=float))

    def of_sums(self, s: np.ndarray) -> np.ndarray:
        """(B, k) sums to (B, q) outputs; a row with anything not finite is NaN throughout."""
        with np.errstate(all="ignore"):
            try:
                out = np.asarray(self.solve(np.atleast_2d(np.asarray(s, dtype=float))), dtype=float)
            except np.linalg.LinAlgError:
                return np.full((len(np.atleast_2d(s)), len(self.outputs)), np.nan)
        out[~np.isfinite(out).all(axis=1)] = np.nan
        return out

    def __call__(self, x: np.ndarray, w: np.ndarray, prep: np.ndarray | None = None) -> np.ndarray:
        try:
            f = self.prepare(x) if prep is None else prep
            return self.of_sums(np.asarray(w, dtype=float) @ f)[0]
        except Exception:  # a statistic never raises
            return np.full(len(self.outputs), np.nan)

    def influence(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        """(N, q): the closed form, or the chain rule on the sums with a complex-free central difference of g."""
        f = self.prepare(x)
        w = np.ones(len(f)) if w is None else np.asarray(w, dtype=float)
        s = w @ f
        theta = self.of_sums(s)[0]
        if not np.isfinite(theta).all():
            return np.full((len(f), len(theta)), np.nan)
        if self._influence is not None:
            return self._influence(np.asarray(x, dtype=float), f, theta, w)
        return f @ gradient(self.of_sums, s).T * len(f)

    def sums(self, df: DataFrame, x: Sequence[str], by: Sequence[str] = (), weight: Column | str | None = None) -> DataFrame:
        """One row for each group with _n and the weighted sums _s0 .. of the features of the columns x."""
        w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
        sums = [F.sum(w * f).alias(f"_s{i}") for i, f in enumerate(self.columns(x))]
        return df.groupBy(*by).agg(F.count("*").alias("_n"), *sums)

    def solved(self, sums: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The outputs of each row of sums: a map over few rows, one for each group, in Arrow batches."""
        k = len([c for c in sums.columns if c.startswith("_s")])
        of_sums, names = self.of_sums, self.outputs

        def run(frames):
            for pdf in frames:
                theta = of_sums(pdf[[f"_s{i}" for i in range(k)]].to_numpy(dtype=float)) if len(pdf) else np.empty((0, len(names)))
                out = pdf[list(keep)].copy()
                for i, o in enumerate(names):
                    out[o] = theta[:, i]
                yield out

        fields = [f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in keep] + [f"`{o}` double" for o in names]
        return sums.mapInPandas(run, ", ".join(fields))

    def by(self, df: DataFrame, x: Sequence[str], by: Sequence[str] = (), weight: Column | str | None = None) -> DataFrame:
        """The statistic of each group: one aggregation, whatever the number of groups."""
        return self.solved(self.sums(df, x, by, weight), by)


def gradient(f: Callable[[np.ndarray], np.ndarray], s: np.ndarray, relative: float = 1e-6) -> np.ndarray:
    """(q, k): central differences of f at s, all steps in one call."""
    h = relative * np.maximum(np.abs(s), 1e-3 * np.abs(s).max(initial=1.0))
    steps = np.diag(h)
    return ((f(s + steps) - f(s - steps)) / (2.0 * h[:, None])).T


# Pareto: shape and tail --------------------------------------------------------------------------------------------------------

X_MIN, ALPHA = 1.0, 2.0
#: The 99th percentile of the Pareto law, a fixed threshold.
PARETO_C = X_MIN * 0.01 ** (-1.0 / ALPHA)


def _column(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1)


def pareto_shape(x_min: float = X_MIN) -> Algebraic:
    """Hill estimator: alpha = sum w / sum w log(x / x_min)."""
    return Algebraic(
        "shape", ("alpha",),
        lambda x: np.column_stack([np.ones(x.size), np.log(_column(x) / x_min)]),
        lambda c: [F.lit(1.0), log_ratio(c[0], x_min)],
        lambda s: s[:, :1] / s[:, 1:2],
        lambda x, f, t, w: (t[0] - t[0] ** 2 * f[:, 1])[:, None],
    )


def pareto_tail(c: float = PARETO_C) -> Algebraic:
    """The share of weight beyond c."""
    return Algebraic(
        "tail", ("P_tail",),
        lambda x: np.column_stack([np.ones(x.size), _column(x) > c]).astype(float),
        lambda k: [F.lit(1.0), tail_indicator(k[0], c)],
        lambda s: s[:, 1:2] / s[:, :1],
        lambda x, f, t, w: f[:, 1:2] - t[0],
    )


def pareto_all(x_min: float = X_MIN, c: float = PARETO_C) -> Algebraic:
    """Both, from one pass."""
    shape, tail = pareto_shape(x_min), pareto_tail(c)
    return Algebraic(
        "all", ("alpha", "P_tail"),
        lambda x: np.column_stack([shape.features(x), tail.features(x)[:, 1]]),
        lambda k: [*shape.columns(k), tail.columns(k)[1]],
        lambda s: np.column_stack([s[:, 0] / s[:, 1], s[:, 2] / s[:, 0]]),
        lambda x, f, t, w: np.column_stack([t[0] - t[0] ** 2 * f[:, 1], f[:, 2] - t[1]]),
    )


# Multivariate t: degrees of freedom and tail --------------------------------------------------------------------------------------

DIM, NU = 10, 5.0
#: The squared radius over the dimension follows F(10, 5); its 99th percentile gives the fixed radius.
MVT_C = math.sqrt(DIM * f_ppf(0.99, DIM, NU))


def mvt_tail(c: float = MVT_C) -> Algebraic:
    return Algebraic(
        "tail", ("P_tail",),
        lambda x: np.column_stack([np.ones(len(x)), (x**2).sum(axis=1) > c * c]).astype(float),
        lambda k: [F.lit(1.0), F.when(F.sqrt(radius_sq(k[0])) > c, 1.0).otherwise(0.0)],
        lambda s: s[:, 1:2] / s[:, :1],
        lambda x, f, t, w: f[:, 1:2] - t[0],
    )


class DegreesOfFreedom:
    """nu of a d-variate t law with known unit scale: the root in log nu of the mean profile score. A root at the cap is a failure."""

    name, outputs, eta, takes_start = "nu", ("nu",), 1e-12, False
    bracket, cap = (0.5, 200.0), (0.1, 1e6)

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def prepare(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        return (x**2).sum(axis=1) if x.ndim == 2 else x

    def common(self, nu: float) -> float:
        """The part of the score that is the same for all points."""
        return 0.5 * (digamma(0.5 * (nu + self.dim)) - digamma(0.5 * nu) - self.dim / nu)

    def own(self, r2: np.ndarray, nu: float) -> np.ndarray:
        """A point's part of the score."""
        return 0.5 * ((nu + self.dim) * r2 / (nu * (nu + r2)) - np.log1p(r2 / nu))

    def score_column(self, r2: Column, nu: float) -> Column:
        return 0.5 * (F.lit(nu + self.dim) * r2 / (F.lit(nu) * (F.lit(nu) + r2)) - F.log1p(r2 / F.lit(nu)))

    def __call__(self, x: np.ndarray, w: np.ndarray, prep: np.ndarray | None = None) -> np.ndarray:
        try:
            r2 = self.prepare(x) if prep is None else prep
            total = float(np.sum(w))
            score = lambda u: self.common(math.exp(u)) + float(w @ self.own(r2, math.exp(u))) / total
            a, b = (math.log(v) for v in self.bracket)
            low, high = (math.log(v) for v in self.cap)
            fa, fb = score(a), score(b)
            while (fa > 0) == (fb > 0):
                if a <= low and b >= high:
                    return np.full(1, np.nan)
                a, b = max(low, a - math.log(4.0)), min(high, b + math.log(4.0))
                fa, fb = score(a), score(b)
            nu = math.exp(brent(score, a, b, 1e-12))
            width = high - low
            inside = math.log(nu) - low > 1e-4 * width and high - math.log(nu) > 1e-4 * width
            return np.array([nu if inside else math.nan])
        except Exception:
            return np.full(1, np.nan)

    def of_table(self, df: DataFrame, r2: Column, weight: Column | None = None, at_once: int = 16, passes: int = 6) -> tuple[int, float, int]:
        """Points, nu (NaN without a root inside the cap) and the passes taken over a table of squared radii. A pass takes the score at at_once
        values of log nu within the bracket, in one aggregation; the root is between two of them, and at last on the line through their
        scores. The first pass has the whole cap for a bracket, so that no pass is spent on finding one."""
        w = F.lit(1.0) if weight is None else weight
        rows = df.select(r2.alias("_r2"), w.cast("double").alias("_w")).filter("_r2 IS NOT NULL AND _w > 0")
        low, high = (math.log(v) for v in self.cap)
        ends: tuple[float, float] | None = None
        n = 0
        for made in range(1, passes + 1):
            first = ends is None
            at = np.linspace(low, high, at_once if first else at_once + 2)
            tried = at if first else at[1:-1]
            nu = [math.exp(u) for u in tried]
            got = rows.agg(F.count("*"), F.sum("_w"), *[F.sum(F.col("_w") * self.score_column(F.col("_r2"), v)) for v in nu]).first()
            n = int(got[0])
            if not n:
                return 0, math.nan, made
            score = [self.common(v) + float(s) / float(got[1]) for v, s in zip(nu, got[2:], strict=True)]
            score = score if first else [ends[0], *score, ends[1]]
            sides = np.sign(score)
            k = next((k for k in range(len(at) - 1) if sides[k] != sides[k + 1]), None)
            if k is None:
                return n, math.nan, made
            low, high, ends = float(at[k]), float(at[k + 1]), (score[k], score[k + 1])
            if high - low < 1e-12:
                break
        u = low + (high - low) * ends[0] / (ends[0] - ends[1]) if ends[0] != ends[1] else low
        lowest, highest = (math.log(v) for v in self.cap)
        edge = 1e-4 * (highest - lowest)
        return n, math.exp(u) if lowest + edge < u < highest - edge else math.nan, made

    def influence(self, x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
        r2 = self.prepare(x)
        w = np.ones(len(r2)) if w is None else w
        nu = self(x, w)[0]
        if not math.isfinite(nu):
            return np.full((len(r2), 1), np.nan)
        h = 1e-4 * nu
        mean = lambda v: self.common(v) + float(w @ self.own(r2, v)) / float(w.sum())
        slope = -(mean(nu + h) - mean(nu - h)) / (2.0 * h)
        return ((self.common(nu) + self.own(r2, nu)) / slope)[:, None]


class MvtAll:
    """nu and the tail probability together; a failure of one fails both."""

    name, outputs, eta, takes_start = "all", ("nu", "P_tail"), 1e-12, False

    def __init__(self, dim: int = DIM, c: float = MVT_C):
        self.nu, self.c = DegreesOfFreedom(dim), c

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return self.nu.prepare(x)

    def __call__(self, x, w, prep=None) -> np.ndarray:
        r2 = self.prepare(x) if prep is None else prep
        nu, total = self.nu(x, w, prep=r2)[0], float(np.sum(w))
        out = np.array([nu, float(w @ (r2 > self.c**2)) / total if total > 0 else math.nan])
        return out if np.isfinite(out).all() else np.full(2, np.nan)

    def influence(self, x, w=None) -> np.ndarray:
        r2 = self.prepare(x)
        w = np.ones(len(r2)) if w is None else w
        tail = (r2 > self.c**2).astype(float)
        return np.column_stack([self.nu.influence(x, w), tail - float(w @ tail) / float(w.sum())])

    def per_point_loss(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Minus the log density of the t law, minus the Bernoulli log likelihood of the tail."""
        r2, (nu, p), d = self.prepare(x), theta, self.nu.dim
        log_t = math.lgamma(0.5 * (nu + d)) - math.lgamma(0.5 * nu) - 0.5 * d * math.log(nu * math.pi) - 0.5 * (nu + d) * np.log1p(r2 / nu)
        tail = r2 > self.c**2
        return -log_t - np.where(tail, math.log(p), math.log1p(-p))


# Plane by weighted total least squares --------------------------------------------------------------------------------------------


def _moments(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means (B, 3) and covariances (B, 3, 3) from (1, x, upper triangle of x x')."""
    mean = s[:, 1:4] / s[:, :1]
    second = np.empty((len(s), 3, 3))
    second[:, *np.triu_indices(3)] = s[:, 4:10] / s[:, :1]
    second = np.triu(second) + np.transpose(np.triu(second, 1), (0, 2, 1))
    return mean, second - mean[:, :, None] * mean[:, None, :]


def plane_of(s: np.ndarray) -> np.ndarray:
    """a, b, c, scatter of z = a x + b y + c: the normal is the eigenvector of the least eigenvalue."""
    mean, cov = _moments(s)
    value, vector = np.linalg.eigh(cov)
    n = vector[:, :, 0]
    n = np.where(n[:, 2:] < 0, -n, n)
    return np.column_stack([-n[:, 0] / n[:, 2], -n[:, 1] / n[:, 2], (n * mean).sum(axis=1) / n[:, 2], np.sqrt(np.maximum(value[:, 0], 0.0))])


def _plane_influence(x: np.ndarray, f: np.ndarray, theta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """First-order perturbation of the least eigenpair of the weighted covariance."""
    mean, cov = (m[0] for m in _moments((w @ f)[None]))
    value, vector = np.linalg.eigh(cov)
    n = vector[:, 0] * (1.0 if vector[2, 0] >= 0 else -1.0)
    y = x - mean
    along = y @ n
    d_value = along**2 - value[0]
    d_n = sum(np.outer((y @ vector[:, k]) * along / (value[0] - value[k]), vector[:, k]) for k in (1, 2))
    a, b, c = theta[:3]
    return np.column_stack([-(d_n[:, 0] + a * d_n[:, 2]) / n[2], -(d_n[:, 1] + b * d_n[:, 2]) / n[2], (d_n @ mean + along - c * d_n[:, 2]) / n[2], d_value / (2.0 * theta[3])])


def fundamental_plane() -> Algebraic:
    upper = list(zip(*np.triu_indices(3), strict=True))
    out = Algebraic(
        "fp", ("a", "b", "c", "scatter"),
        lambda x: np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i, j in upper)]),
        lambda k: [F.lit(1.0), *(F.col(c) for c in k), *(F.col(k[i]) * F.col(k[j]) for i, j in upper)],
        plane_of,
        _plane_influence,
        eta=1e-14,
    )
    out.per_point_loss = lambda x, t: (x[:, 2] - t[0] * x[:, 0] - t[1] * x[:, 1] - t[2]) ** 2 / (1.0 + t[0] ** 2 + t[1] ** 2)
    return out


# Mass function: lognormal below the break, power law above ------------------------------------------------------------------------

M_BREAK, M_MIN = 1.0, 0.0017582750879228115
#: Search box of m_c (in its logarithm), sigma and x.
MASS_BOX = ((0.01, 5.0), (0.02, 5.0), (0.05, 10.0))


class MassFunction(Algebraic):
    """Chabrier law: density per log10 mass a Gaussian up to m_b, joined without a step to a power law m**-x above. The likelihood
    depends on the masses through seven sums only, so that every evaluation is a Newton search over three parameters."""

    def __init__(self, m_b: float = M_BREAK, m_min: float = M_MIN):
        self.m_b, self.m_min, self.u_b, self.u_min = m_b, m_min, math.log10(m_b), math.log10(m_min)
        super().__init__("Chabrier", ("m_c", "sigma", "x"), self._features, self._columns, self._solve, eta=1e-12)

    def _features(self, m: np.ndarray) -> np.ndarray:
        m = m.reshape(-1)
        low, u = (m <= self.m_b).astype(float), np.log10(m)
        return np.column_stack([np.ones(len(m)), low, low * u, low * u * u, 1.0 - low, (1.0 - low) * u])

    def _columns(self, k: Sequence[str]) -> list[Column]:
        m = F.col(k[0])
        u = log10(m)
        low = F.when(m <= self.m_b, 1.0).otherwise(0.0)
        return [F.lit(1.0), low, low * u, low * u * u, 1.0 - low, (1.0 - low) * u]

    def mean_log_likelihood(self, s: np.ndarray, p: np.ndarray) -> float:
        """p: log10 m_c, log sigma, x. Per unit weight, of the density in log10 m, normalised from m_min to infinity."""
        mu, sigma, x = p[0], math.exp(p[1]), p[2]
        z_b, z_0 = (self.u_b - mu) / sigma, (self.u_min - mu) / sigma
        join = math.exp(-0.5 * z_b * z_b)
        area = sigma * math.sqrt(2.0 * math.pi) * 0.5 * (math.erfc(-z_b / math.sqrt(2.0)) - math.erfc(-z_0 / math.sqrt(2.0))) + join / (x * math.log(10.0))
        low = -0.5 * (s[3] - 2.0 * mu * s[2] + mu * mu * s[1]) / sigma**2
        high = -0.5 * z_b * z_b * s[4] - x * math.log(10.0) * (s[5] - self.u_b * s[4])
        return (low + high) / s[0] - math.log(area)

    def _solve(self, sums: np.ndarray) -> np.ndarray:
        out = np.full((len(sums), 3), np.nan)
        box = np.array([[math.log10(MASS_BOX[0][0]), math.log10(MASS_BOX[0][1])], [math.log(MASS_BOX[1][0]), math.log(MASS_BOX[1][1])], list(MASS_BOX[2])])
        for r, s in enumerate(sums):
            if s[1] <= 0 or s[4] <= 0 or not np.isfinite(s).all():
                continue
            mean = s[2] / s[1]
            var = max(s[3] / s[1] - mean * mean, 1e-4)
            p = np.clip([mean, 0.5 * math.log(var), min(8.0, max(0.2, s[4] / max((s[5] - self.u_b * s[4]) * math.log(10.0), 1e-9)))], box[:, 0] + 1e-3, box[:, 1] - 1e-3)
            f = lambda v, s=s: self.mean_log_likelihood(s, v)
            p = newton_max(f, p, box)
            if p is not None and (np.minimum(p - box[:, 0], box[:, 1] - p) > 1e-4 * (box[:, 1] - box[:, 0])).all():
                out[r] = 10.0 ** p[0], math.exp(p[1]), p[2]
        return out


def derivatives(f: Callable[[np.ndarray], float], p: np.ndarray, h: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by fourth-order and second-order central differences."""
    n = len(p)
    e = np.eye(n) * h * np.maximum(1.0, np.abs(p))
    step = np.diag(e)
    f0 = f(p)
    one = np.array([[f(p - 2 * d), f(p - d), f(p + d), f(p + 2 * d)] for d in e])
    g = (one[:, 0] - 8 * one[:, 1] + 8 * one[:, 2] - one[:, 3]) / (12 * step)
    hess = np.diag((-one[:, 0] + 16 * one[:, 1] - 30 * f0 + 16 * one[:, 2] - one[:, 3]) / (12 * step**2))
    for i in range(n):
        for j in range(i):
            v = (f(p + e[i] + e[j]) - f(p + e[i] - e[j]) - f(p - e[i] + e[j]) + f(p - e[i] - e[j])) / (4 * step[i] * step[j])
            hess[i, j] = hess[j, i] = v
    return g, hess


def newton_max(f: Callable[[np.ndarray], float], p: np.ndarray, box: np.ndarray, steps: int = 100, tol: float = 1e-11) -> np.ndarray | None:
    """A maximum of f in the box by damped Newton steps, uphill along gradient directions where f is not concave."""
    value = f(p)
    for _ in range(steps):
        g, h = derivatives(f, p)
        lam, vec = np.linalg.eigh(h)
        lam = -np.maximum(np.abs(lam), 1e-8)
        step = -(vec @ ((vec.T @ g) / lam))
        size = 1.0
        while size > 1e-10:
            q = np.clip(p + size * step, box[:, 0], box[:, 1])
            new = f(q)
            if new >= value:
                break
            size *= 0.5
        else:
            return p
        moved = float(np.abs(q - p).max())
        p, value = q, new
        if moved < tol:
            return p
    return p
