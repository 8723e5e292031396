"""Scalar numerics on NumPy and the standard library: normal, chi-square and F laws, digamma, root finding, minimum-cost
assignment, pivoted Cholesky, and the law of a weighted sum of chi-square variables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    return math.inf if p >= 1.0 else _NORMAL.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction (Lentz) above."""
    if x <= 0.0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return min(1.0, total * front)
    tiny, b = 1e-300, x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return 1.0 - front * h


def chi2_cdf(x: float, df: float) -> float:
    if df == 1.0:
        return math.erf(math.sqrt(max(x, 0.0) / 2.0))
    return gamma_p(df / 2.0, x / 2.0)


def chi2_ppf(p: float, df: float) -> float:
    if df == 1.0:
        return norm_ppf((1.0 + p) / 2.0) ** 2
    if p <= 0.0:
        return 0.0
    high = max(df, 1.0)
    while chi2_cdf(high, df) < p:
        high *= 2.0
    return brent(lambda x: chi2_cdf(x, df) - p, 0.0, high, 1e-14)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_i(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or tiny)
            c = (1.0 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 / 2.0, d2 / 2.0, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def f_ppf(p: float, d1: float, d2: float) -> float:
    high = 1.0
    while f_cdf(high, d1, d2) < p:
        high *= 2.0
    return brent(lambda x: f_cdf(x, d1, d2) - p, 0.0, high, 1e-14)


def digamma(x: float) -> float:
    """By recurrence to x >= 10, then the asymptotic series."""
    shift = 0.0
    while x < 10.0:
        shift -= 1.0 / x
        x += 1.0
    y = 1.0 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))


def brent(f: Callable[[float], float], a: float, b: float, xtol: float = 1e-12) -> float:
    """A root of f between a and b, where f has different signs (Brent's method)."""
    fa, fb = f(a), f(b)
    if fa == 0.0:
        return a
    if fb == 0.0:
        return b
    if (fa > 0) == (fb > 0):
        raise ValueError("no change of sign")
    c, fc = a, fa
    d = e = b - a
    for _ in range(500):
        if (fb > 0) == (fc > 0):
            c, fc = a, fa
            d = e = b - a
        if abs(fc) < abs(fb):
            a, b, c = b, c, b
            fa, fb, fc = fb, fc, fb
        tol = 2.0 * 2.220446049250313e-16 * abs(b) + 0.5 * xtol
        half = 0.5 * (c - b)
        if abs(half) <= tol or fb == 0.0:
            return b
        if abs(e) >= tol and abs(fa) > abs(fb):
            s = fb / fa
            if a == c:
                p, q = 2.0 * half * s, 1.0 - s
            else:
                q, r = fa / fc, fb / fc
                p = s * (2.0 * half * q * (q - r) - (b - a) * (r - 1.0))
                q = (q - 1.0) * (r - 1.0) * (s - 1.0)
            p, q = (p, -q) if p > 0 else (-p, q)
            if 2.0 * p < min(3.0 * half * q - abs(tol * q), abs(e * q)):
                e, d = d, p / q
            else:
                d = e = half
        else:
            d = e = half
        a, fa = b, fb
        b += d if abs(d) > tol else math.copysign(tol, half)
        fb = f(b)
    return b


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least total cost (shortest augmenting paths with potentials)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], j = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            i = owner[j]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i - 1, free - 1] - u[i] - v[free]
            better = now < least[free]
            least[free[better]] = now[better]
            way[free[better]] = j
            k = free[np.argmin(least[free])]
            delta = least[k]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    out = np.empty(n, dtype=int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def pivoted_cholesky(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """L, the pivots and the rank r: g[piv][:, piv] = L L' to rounding for the first r pivots."""
    a, n = np.array(g, dtype=float), len(g)
    piv, low = np.arange(n), np.zeros((n, n))
    d = np.diag(a).copy()
    stop = n * np.finfo(float).eps * max(d.max(initial=0.0), 0.0)
    for k in range(n):
        j = k + int(np.argmax(d[k:]))
        if d[j] <= stop:
            return low[:k, :k], piv, k
        if j != k:
            piv[[k, j]], d[[k, j]] = piv[[j, k]], d[[j, k]]
            low[[k, j], :k] = low[[j, k], :k]
        low[k, k] = math.sqrt(d[k])
        rest = piv[k + 1 :]
        low[k + 1 :, k] = (a[rest, piv[k]] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        d[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, piv, n


@lru_cache(maxsize=1)
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(16)


def _inversion(w: np.ndarray, x: float) -> float:
    """P(sum w chi2_1 <= x) by numerical inversion of the characteristic function (Imhof, 1961), w > 0, mean 1. The integrand is
    summed over panels; past the last one, where its amplitude is below 1e-12 of the answer, it is dropped."""
    node, mass = _nodes()
    node, mass = 0.5 * (node + 1.0), 0.5 * mass
    # The integral of sin(theta(t)) / (t rho(t)) over t > 0, panels as long as half a turn of the phase.
    total, at = 0.0, 0.0
    step = min(2.0, math.pi / max(x, w.sum()))
    batch = 64
    for _ in range(4000):
        t = (at + step * np.arange(batch))[:, None] + step * node[None]
        wt = w[:, None] * t.reshape(-1)[None]
        phase = 0.5 * np.arctan(wt).sum(axis=0) - 0.5 * x * t.reshape(-1)
        size = 0.25 * np.log1p(wt**2).sum(axis=0) + np.log(t.reshape(-1))
        total += step * float((np.sin(phase) * np.exp(-size)).reshape(batch, -1).sum(axis=0) @ mass)
        at += step * batch
        size = math.exp(-0.25 * float(np.log1p((w * at) ** 2).sum())) / at
        slope = 0.5 * float((w / (1.0 + (w * at) ** 2)).sum()) - 0.5 * x
        # What is left is size cos(phase) / -slope and terms smaller by (1 + n / 2) / (at slope) squared.
        if at > 4.0 / float(w.max()) and size * (1.0 + 0.5 * len(w)) ** 2 / (at * abs(slope)) ** 2 < 1e-11 * abs(slope):
            phase = 0.5 * float(np.arctan(w * at).sum()) - 0.5 * x * at
            total += size * math.cos(phase) / slope
            break
        if at * w.max() > 50.0:  # the phase is linear by now: longer panels, a fixed number of turns each
            step = min(step * 1.5, math.pi / x)
    return min(1.0, max(0.0, 0.5 - total / math.pi))


def wchi2_cdf(w, x: float) -> float:
    """P(sum w_i chi2_1 <= x sum w_i). Weights <= 0 are left out; without any the sum is 0."""
    w = np.asarray(w, dtype=float)
    w = w[w > 0]
    if not len(w):
        return 1.0
    if len(w) == 1 or w.max() == w.min():
        return chi2_cdf(x * len(w), float(len(w)))
    return _inversion(w / w.sum(), x) if x > 0 else 0.0


def wchi2_quantile(w, p: float) -> float:
    """q with P(sum w_i chi2_1 <= q sum w_i) = p: one weight gives the chi-square law with 1 degree, none 1."""
    w = np.asarray(w, dtype=float)
    w = w[w > 0]
    if not len(w):
        return 1.0
    if len(w) == 1 or w.max() == w.min():
        return chi2_ppf(p, float(len(w))) / len(w)
    w = w / w.sum()
    df = 1.0 / float((w**2).sum())
    low = high = chi2_ppf(p, df) / df  # two moments give the first guess
    while _inversion(w, low) > p:
        low *= 0.5
    while _inversion(w, high) < p:
        high *= 1.5
    return brent(lambda x: _inversion(w, x) - p, low, high, 1e-10) if low < high else low
