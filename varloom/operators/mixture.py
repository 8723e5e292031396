"""Penalised maximum-likelihood mixtures in the plane: Gaussians with free covariances, with or without one sheared filament.

The filament's density is N(x | m, s2x) N(y | b0 + b1 sin wx + b2 cos wx, s2p). Covariances carry the penalty of Chen and Tan with
weight 1 / sum w, towards the data's covariance. A fit continues from a start, or searches cold: components are inserted one by one
where a partial EM against the frozen rest gains most, from several beginnings; these race with k-means starts, and the survivors are refined;
split and merge and relocation moves follow. EM is accelerated by squared extrapolation and finished by Newton steps in unconstrained
parameters, with gradient and Hessian in closed form. The search itself is in mixture_search.

Influences are psi = -N H^-1 s with the points' scores s and the penalised Hessian H, refused where H is too ill-conditioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from varloom.functions.numerics import assignment
from varloom.operators.quantize import kmeans

OMEGA = math.pi / 2.64
CONDITION_LIMIT = 1e12
LOG_2PI = math.log(2.0 * math.pi)


@dataclass
class Parameters:
    """Weights of all components (the filament's last), means, covariances, and the filament (m, s2x, b0, b1, b2, s2p) or None."""

    w: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    thread: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.mean)

    def feasible(self) -> bool:
        det = self.cov[:, 0, 0] * self.cov[:, 1, 1] - self.cov[:, 0, 1] ** 2
        ok = np.isfinite(self.w).all() and (self.w > 0).all() and np.isfinite(self.cov).all() and (det > 0).all() and (self.cov[:, 0, 0] > 0).all()
        return bool(ok and (self.thread is None or np.isfinite(self.thread).all() and self.thread[1] > 0 and self.thread[5] > 0))

    def vector(self) -> np.ndarray:
        """Free weights, means, covariances (11, 12, 22), filament."""
        parts = [self.w[:-1], self.mean.reshape(-1), np.column_stack([self.cov[:, 0, 0], self.cov[:, 0, 1], self.cov[:, 1, 1]]).reshape(-1)]
        return np.concatenate([*parts, self.thread] if self.thread is not None else parts)

    def permuted(self, order: np.ndarray) -> Parameters:
        return Parameters(np.concatenate([self.w[: self.k][order], self.w[self.k :]]), self.mean[order], self.cov[order], self.thread)


def unpacked(theta: np.ndarray, k: int, thread: bool) -> Parameters:
    free = k if thread else k - 1
    w = np.append(theta[:free], 1.0 - theta[:free].sum())
    mean = theta[free : free + 2 * k].reshape(k, 2)
    c = theta[free + 2 * k : free + 5 * k].reshape(k, 3)
    return Parameters(w, mean.copy(), np.stack([c[:, [0, 1]], c[:, [1, 2]]], axis=1), theta[free + 5 * k :].copy() if thread else None)


def theta_of(w: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """The parameter vector of a Gaussian mixture, components by (mean x, mean y)."""
    order = np.lexsort((mean[:, 1], mean[:, 0]))
    return Parameters(w, mean, cov).permuted(order).vector()


def names(k: int, thread: bool) -> tuple[str, ...]:
    free = k if thread else k - 1
    out = [f"pi{i + 1}" for i in range(free)] + [f"mu{i + 1}{a}" for i in range(k) for a in "xy"] + [f"S{i + 1}_{c}" for i in range(k) for c in ("11", "12", "22")]
    return tuple(out + (["fil_m", "fil_s2x", "fil_b0", "fil_b1", "fil_b2", "fil_s2p"] if thread else []))


def basis(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.sin(OMEGA * x), np.cos(OMEGA * x)])


def factors(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l11, l21, l22 of the Cholesky factors."""
    a = np.sqrt(cov[:, 0, 0])
    b = cov[:, 0, 1] / a
    return a, b, np.sqrt(np.maximum(cov[:, 1, 1] - b * b, 1e-300))


def standardised(x: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = factors(p.cov)
    z1 = (x[:, :1] - p.mean[:, 0]) / a
    return z1, (x[:, 1:] - p.mean[:, 1] - b * z1) / c


def log_parts(x: np.ndarray, phi: np.ndarray, p: Parameters) -> np.ndarray:
    """(N, components) log of weight times density."""
    a, _, c = factors(p.cov)
    z1, z2 = standardised(x, p)
    out = -LOG_2PI - np.log(a * c) - 0.5 * (z1 * z1 + z2 * z2)
    if p.thread is not None:
        m, s2x, s2p = p.thread[0], p.thread[1], p.thread[5]
        e = x[:, 1] - phi @ p.thread[2:5]
        own = -LOG_2PI - 0.5 * math.log(s2x * s2p) - 0.5 * (x[:, 0] - m) ** 2 / s2x - 0.5 * e * e / s2p
        out = np.column_stack([out, own])
    return out + np.log(p.w)


def log_density(parts: np.ndarray) -> np.ndarray:
    top = parts.max(axis=1)
    return top + np.log(np.exp(parts - top[:, None]).sum(axis=1))


class Data:
    """Points, weights, basis, and the covariance that the penalty leans on."""

    def __init__(self, x: np.ndarray, w: np.ndarray, phi: np.ndarray | None = None):
        self.x, self.w, self.total = x, w, float(w.sum())
        self.phi = basis(x[:, 0]) if phi is None else phi
        centre = w @ x / self.total
        y = x - centre
        self.cov = (y * w[:, None]).T @ y / self.total
        self.a = 1.0 / self.total

    def penalty(self, p: Parameters) -> float:
        det = p.cov[:, 0, 0] * p.cov[:, 1, 1] - p.cov[:, 0, 1] ** 2
        trace = (self.cov[0, 0] * p.cov[:, 1, 1] - 2 * self.cov[0, 1] * p.cov[:, 0, 1] + self.cov[1, 1] * p.cov[:, 0, 0]) / det
        return -self.a * float((trace + np.log(det)).sum())

    def log_likelihood(self, p: Parameters) -> float:
        return float(self.w @ log_density(log_parts(self.x, self.phi, p))) + self.penalty(p)

    def information(self, u: np.ndarray, k: int, thread: bool) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised log likelihood, its gradient and its Hessian in the unconstrained parameters."""
        p = from_free(u, k, thread)
        value, slope, h = louis(self.x, self.phi, self.w, p)
        return value + self.penalty(p), slope + penalty_gradient(self, u, k, thread), h + penalty_curvature(self, u, k, thread)

    def em_all(self, starts: list[Parameters]) -> list[tuple[Parameters, float]]:
        return [self.em(p) for p in starts]

    def em(self, p: Parameters) -> tuple[Parameters, float]:
        """One step, and the penalised log likelihood before it."""
        value, sums = em_sums(self.x, self.phi, self.w, p)
        return stepped(sums, p, self), value + self.penalty(p)

    def against(self, p: Parameters) -> Callable:
        """Sums of candidates for a new component beside p, whose density is taken once."""
        frozen = log_density(log_parts(self.x, self.phi, p))
        return lambda share, mean, cov: candidate_sums(self.x, self.phi, self.w, frozen, share, mean, cov)

    def move_scores(self, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
        from varloom.operators.mixture_search import of_sums

        return of_sums(move_sums(self.x, self.phi, p))


def em_sums(x: np.ndarray, phi: np.ndarray, w: np.ndarray, p: Parameters) -> tuple[float, np.ndarray]:
    """The log likelihood and, by component, the weighted sums that an M step needs: 1, x, y, xx, xy, yy and, if there is a filament, the six
    of phi phi' and the three of phi y. All add over parts of the data."""
    parts = log_parts(x, phi, p)
    f = log_density(parts)
    r = np.exp(parts - f[:, None]) * w[:, None]
    terms = [np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2]
    if p.thread is not None:
        terms += [phi[:, i] * phi[:, j] for i in range(3) for j in range(i, 3)] + [phi[:, i] * x[:, 1] for i in range(3)]
    return float(w @ f), r.T @ np.column_stack(terms)


def stepped(sums: np.ndarray, p: Parameters, data) -> Parameters:
    """The M step. data: total, cov, a."""
    n, g = sums[:, 0], sums[: p.k]
    m = np.maximum(g[:, 0], 1e-12)
    mean = g[:, 1:3] / m[:, None]
    c11, c12, c22 = g[:, 3] / m - mean[:, 0] ** 2, g[:, 4] / m - mean[:, 0] * mean[:, 1], g[:, 5] / m - mean[:, 1] ** 2
    raw = np.stack([np.column_stack([c11, c12]), np.column_stack([c12, c22])], axis=1)
    cov = (m[:, None, None] * raw + 2.0 * data.a * data.cov) / (m + 2.0 * data.a)[:, None, None]
    thread = None
    if p.thread is not None:
        t = sums[-1]
        nt, square = max(t[0], 1e-12), np.zeros((3, 3))
        square[np.triu_indices(3)] = t[6:12]
        square += square.T - np.diag(np.diag(square))
        b = np.linalg.lstsq(square + 1e-12 * np.eye(3), t[12:15], rcond=None)[0]
        left = t[5] - 2.0 * b @ t[12:15] + b @ square @ b
        thread = np.array([t[1] / nt, max((t[3] - t[1] ** 2 / nt) / nt, 1e-8), *b, max(left / nt, 1e-10)])
    return Parameters(np.maximum(n, 1e-300) / data.total, mean, cov, thread)


def candidate_sums(x: np.ndarray, phi: np.ndarray, w: np.ndarray, frozen: np.ndarray, share: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """For each candidate beside a mixture with log density frozen: the gain in log likelihood, and its sums n, x, y, xx, xy, yy."""
    own = log_parts(x, phi, Parameters(share, mean, cov))
    both = np.logaddexp(own, frozen[:, None] + np.log1p(-share))
    r = np.exp(own - both) * w[:, None]
    terms = np.column_stack([np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2])
    return np.column_stack([w @ (both - frozen[:, None]), r.T @ terms])


def move_sums(x: np.ndarray, phi: np.ndarray, p: Parameters) -> dict[str, np.ndarray]:
    """What split and merge scores need, of the Gaussians; points count once each."""
    parts = log_parts(x, phi, p)
    r = np.exp(parts - log_density(parts)[:, None])[:, : p.k]
    log_f = parts[:, : p.k] - np.log(p.w[: p.k])
    with np.errstate(all="ignore"):
        rlr = np.where(r > 0.0, r * np.log(np.maximum(r, 1e-300)), 0.0)
    return {"rr": r.T @ r, "r": r.sum(axis=0), "rlr": rlr.sum(axis=0), "rlf": (r * log_f).sum(axis=0), "f": np.exp(log_f).sum(axis=0)}


# Unconstrained parameters -------------------------------------------------------------------------------------------------------


def to_free(p: Parameters) -> np.ndarray:
    """Logits against the last weight, means, (log l11, l21, log l22), (m, log s2x, b, log s2p)."""
    a, b, c = factors(p.cov)
    parts = [np.log(p.w[:-1] / p.w[-1]), p.mean.reshape(-1), np.column_stack([np.log(a), b, np.log(c)]).reshape(-1)]
    if p.thread is not None:
        t = p.thread
        parts.append(np.array([t[0], math.log(t[1]), *t[2:5], math.log(t[5])]))
    return np.concatenate(parts)


def from_free(u: np.ndarray, k: int, thread: bool) -> Parameters:
    free = k if thread else k - 1
    logit = np.append(u[:free], 0.0)
    e = np.exp(logit - logit.max())
    c = u[free + 2 * k : free + 5 * k].reshape(k, 3)
    a, b, d = np.exp(c[:, 0]), c[:, 1], np.exp(c[:, 2])
    cov = np.stack([np.column_stack([a * a, a * b]), np.column_stack([a * b, b * b + d * d])], axis=1)
    t = u[free + 5 * k :]
    return Parameters(e / e.sum(), u[free : free + 2 * k].reshape(k, 2).copy(), cov, np.array([t[0], math.exp(t[1]), *t[2:5], math.exp(t[5])]) if thread else None)


def scores(x: np.ndarray, phi: np.ndarray, p: Parameters) -> np.ndarray:
    """(N, parameters): the gradient of each point's log density in the unconstrained parameters."""
    parts = log_parts(x, phi, p)
    r = np.exp(parts - log_density(parts)[:, None])
    g = r[:, : p.k]
    a, b, c = factors(p.cov)
    z1, z2 = standardised(x, p)
    mean = np.stack([g * (z1 / a - z2 * b / (a * c)), g * z2 / c], axis=2).reshape(len(x), -1)
    shape = np.stack([g * (z1 * z1 - 1.0 - z1 * z2 * b / c), g * z1 * z2 / c, g * (z2 * z2 - 1.0)], axis=2).reshape(len(x), -1)
    out = [r[:, :-1] - p.w[:-1], mean, shape]
    if p.thread is not None:
        t, m = r[:, -1:], p.thread
        d, e = x[:, :1] - m[0], x[:, 1:] - (phi @ m[2:5])[:, None]
        out.append(t * np.column_stack([d / m[1], 0.5 * (d * d / m[1] - 1.0), phi * e / m[5], 0.5 * (e * e / m[5] - 1.0)]))
    return np.column_stack(out)


def _penalty_terms(cov: np.ndarray, u: np.ndarray, k: int, thread: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each component, of tr(cov S^-1) + log det S in (log l11, l21, log l22): gradient (K, 3), Hessian (K, 3, 3), and how the gradient
    moves with the entries 11, 12, 22 of cov (K, 3, 3)."""
    free = k if thread else k - 1
    c = u[free + 2 * k : free + 5 * k].reshape(k, 3)
    b, e1, e2 = c[:, 1], np.exp(-2.0 * c[:, 0]), np.exp(-2.0 * c[:, 2])
    e, f = e1 * e2, np.exp(-c[:, 0]) * e2
    zero = np.zeros(k)
    by_cov = np.array([[-2.0 * (e1 + b * b * e), 2.0 * b * f, zero], [2.0 * b * e, -2.0 * f, zero], [-2.0 * b * b * e, 4.0 * b * f, -2.0 * e2]]).transpose(2, 0, 1)
    s11, s12, s22 = cov[0, 0], cov[0, 1], cov[1, 1]
    slope = by_cov @ np.array([s11, s12, s22]) + np.array([2.0, 0.0, 2.0])
    t2, t3 = s11 * b * b * e, -2.0 * s12 * b * f
    aa, ab, ac = 4.0 * s11 * e1 + 4.0 * t2 + t3, -4.0 * s11 * b * e + 2.0 * s12 * f, 4.0 * t2 + 2.0 * t3
    bb, bc, cc = 2.0 * s11 * e, -4.0 * s11 * b * e + 4.0 * s12 * f, 4.0 * (t2 + t3 + s22 * e2)
    return slope, np.array([[aa, ab, ac], [ab, bb, bc], [ac, bc, cc]]).transpose(2, 0, 1), by_cov


def _places(i: int, k: int, thread: bool) -> np.ndarray:
    """Where a Gaussian's mean and covariance parameters stand."""
    free = k if thread else k - 1
    return np.concatenate([free + 2 * i + np.arange(2), free + 2 * k + 3 * i + np.arange(3)])


def penalty_gradient(data: Data, u: np.ndarray, k: int, thread: bool) -> np.ndarray:
    out = np.zeros(len(u))
    free = k if thread else k - 1
    out[free + 2 * k : free + 5 * k] = -data.a * _penalty_terms(data.cov, u, k, thread)[0].reshape(-1)
    return out


def penalty_curvature(data: Data, u: np.ndarray, k: int, thread: bool) -> np.ndarray:
    out = np.zeros((len(u), len(u)))
    for i, h in enumerate(_penalty_terms(data.cov, u, k, thread)[1]):
        at = _places(i, k, thread)[2:]
        out[np.ix_(at, at)] = -data.a * h
    return out


def penalty_sensitivity(data: Data, u: np.ndarray, k: int, thread: bool) -> np.ndarray:
    """(N, parameters): how the penalty's gradient moves with each weight at a constant sum, through the data's covariance."""
    slope = np.zeros((len(u), 3))
    free = k if thread else k - 1
    slope[free + 2 * k : free + 5 * k] = _penalty_terms(data.cov, u, k, thread)[2].reshape(-1, 3)
    y = data.x - data.w @ data.x / data.total
    moved = np.column_stack([y[:, 0] ** 2 - data.cov[0, 0], y[:, 0] * y[:, 1] - data.cov[0, 1], y[:, 1] ** 2 - data.cov[1, 1]])
    return -data.a / data.total * moved @ slope.T


def gradient(data: Data, u: np.ndarray, k: int, thread: bool) -> np.ndarray:
    return data.w @ scores(data.x, data.phi, from_free(u, k, thread)) + penalty_gradient(data, u, k, thread)


def louis(x: np.ndarray, phi: np.ndarray, w: np.ndarray, p: Parameters) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood, its gradient and its Hessian in the unconstrained parameters, as sums over points (Louis, 1982): of each
    component's own curvature and outer score by responsibility, less the outer product of the point's score. They add over parts of the
    data, so that tasks can each take theirs."""
    parts = log_parts(x, phi, p)
    f = log_density(parts)
    r = np.exp(parts - f[:, None]) * w[:, None]
    k, thread, free = p.k, p.thread is not None, len(p.w) - 1
    u_size = free + 5 * k + (6 if thread else 0)
    s = scores(x, phi, p)
    h = -(s * w[:, None]).T @ s
    n, pi = r.sum(axis=0), p.w[:free]
    total = float(w.sum())
    # Weights: E[(e - pi)(e - pi)'] - (diag pi - pi pi') for each point.
    h[:free, :free] += np.diag(n[:free]) - np.outer(n[:free], pi) - np.outer(pi, n[:free]) + total * np.outer(pi, pi) - total * (np.diag(pi) - np.outer(pi, pi))
    a, b, c = factors(p.cov)
    z1, z2 = standardised(x, p)
    for i in range(k):
        at, ri, y1, y2 = _places(i, k, thread), r[:, i], z1[:, i], z2[:, i]
        ai, bi, ci = a[i], b[i], c[i]
        one = np.column_stack([y1 / ai - y2 * bi / (ai * ci), y2 / ci, y1 * y1 - 1.0 - y1 * y2 * bi / ci, y1 * y2 / ci, y2 * y2 - 1.0])
        own = (one * ri[:, None]).T @ one
        # Derivatives of z1 and z2 by mean 1, mean 2, log l11, l21, log l22 are linear in (1, z1, z2).
        m = np.array([float(ri @ v) for v in (np.ones(len(x)), y1, y2, y1 * y1, y1 * y2, y2 * y2)])
        d1 = np.array([[-1.0 / ai, 0, 0], [0, 0, 0], [0, -1.0, 0], [0, 0, 0], [0, 0, 0]])
        d2 = np.array([[bi / (ai * ci), 0, 0], [-1.0 / ci, 0, 0], [0, bi / ci, 0], [0, -1.0 / ci, 0], [0, 0, -1.0]])
        second = np.array([[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]])
        own -= d1 @ second @ d1.T + d2 @ second @ d2.T
        mixed = np.zeros((5, 5))  # sums of z1 times second derivatives of z1, and of z2 times those of z2
        mixed[0, 2] = m[1] / ai - bi / (ai * ci) * m[2]
        mixed[2, 2] = m[3] - bi / ci * m[4]
        mixed[0, 3], mixed[0, 4], mixed[1, 4] = m[2] / (ai * ci), -bi / (ai * ci) * m[2], m[2] / ci
        mixed[2, 3], mixed[2, 4], mixed[3, 4], mixed[4, 4] = m[4] / ci, -bi / ci * m[4], m[4] / ci, m[5]
        own -= mixed + mixed.T - np.diag(np.diag(mixed))
        h[np.ix_(at, at)] += own
        e = np.zeros(free)
        if i < free:
            e[i] = 1.0
        cross = np.outer(e - pi, ri @ one)
        h[np.ix_(np.arange(free), at)] += cross
        h[np.ix_(at, np.arange(free))] += cross.T
    if thread:
        at, t, q = np.arange(u_size - 6, u_size), r[:, -1], p.thread
        d, e = x[:, 0] - q[0], x[:, 1] - phi @ q[2:5]
        one = np.column_stack([d / q[1], 0.5 * (d * d / q[1] - 1.0), phi * e[:, None] / q[5], 0.5 * (e * e / q[5] - 1.0)])
        own = (one * t[:, None]).T @ one
        own[0, 0] -= t.sum() / q[1]
        own[0, 1] -= t @ d / q[1]
        own[1, 0] -= t @ d / q[1]
        own[1, 1] -= 0.5 * t @ (d * d) / q[1]
        own[2:5, 2:5] -= (phi * t[:, None]).T @ phi / q[5]
        own[2:5, 5] -= phi.T @ (t * e) / q[5]
        own[5, 2:5] -= phi.T @ (t * e) / q[5]
        own[5, 5] -= 0.5 * t @ (e * e) / q[5]
        h[np.ix_(at, at)] += own
        cross = np.outer(-pi, t @ one)
        h[np.ix_(np.arange(free), at)] += cross
        h[np.ix_(at, np.arange(free))] += cross.T
    return float(w @ f), w @ s, h


def hessian(data: Data, u: np.ndarray, k: int, thread: bool) -> np.ndarray:
    out = data.information(u, k, thread)[2]
    return 0.5 * (out + out.T)


def trust_step(g: np.ndarray, h: np.ndarray, radius: float) -> np.ndarray:
    """The maximiser of g'd + d'Hd / 2 within the radius (More and Sorensen): the eigenvalues of -H shifted until the step fits."""
    lam, vec = np.linalg.eigh(-h)
    b = vec.T @ g
    if lam[0] > 0:
        d = b / lam
        if np.linalg.norm(d) <= radius:
            return vec @ d
    low, high = max(0.0, -lam[0]), max(0.0, -lam[0]) + np.linalg.norm(g) / radius + 1.0
    near = lam + low
    if low > 0 and np.linalg.norm(np.where(near > 1e-12 * max(1.0, abs(lam[-1])), b / np.maximum(near, 1e-300), 0.0)) < radius:
        d = np.where(near > 1e-12 * max(1.0, abs(lam[-1])), b / np.maximum(near, 1e-300), 0.0)  # the hard case: along the lowest curvature
        d[0] += math.copysign(math.sqrt(max(radius**2 - float(d @ d), 0.0)), b[0])
        return vec @ d
    for _ in range(100):
        mid = 0.5 * (low + high)
        if np.linalg.norm(b / (lam + mid)) > radius:
            low = mid
        else:
            high = mid
    return vec @ (b / (lam + high))


# Fitting ------------------------------------------------------------------------------------------------------------------------


def finished(data: Data, p: Parameters, eta: float, steps: int = 40) -> tuple[Parameters, float, str]:
    """Newton steps in a trust region until the step's predicted gain is below eta."""
    k, thread = p.k, p.thread is not None
    u, value, radius = to_free(p), data.log_likelihood(p), 1.0
    h = None
    for _ in range(steps):
        if h is None:
            _, g, h = data.information(u, k, thread)
            h = 0.5 * (h + h.T)
        d = trust_step(g, h, radius)
        gain = float(g @ d + 0.5 * d @ h @ d)
        if gain <= eta * 1e-3 * max(abs(value), 1.0):
            if np.linalg.eigvalsh(h)[-1] >= 0.0:
                return from_free(u, k, thread), value, "saddle"
            q = from_free(u + d, k, thread)
            return (q if q.feasible() and data.log_likelihood(q) >= value - 1e-12 * abs(value) else from_free(u, k, thread)), value, "converged"
        new = -math.inf
        for way in (d, -d):  # where the curvature is upward, either side may rise
            q = from_free(u + way, k, thread)
            new = data.log_likelihood(q) if q.feasible() else -math.inf
            if new > value or float(g @ d) > 1e-3 * gain and float(d @ h @ d) < 0:
                break
        d = way
        if new > value:
            if new - value > 0.75 * gain:
                radius *= 2.0
            u, value, h = u + d, new, None
        else:
            radius = 0.25 * float(np.linalg.norm(d))
            if radius < 1e-10:
                return from_free(u, k, thread), value, "newton_stalled"
    return from_free(u, k, thread), value, "newton_cap"


def bhattacharyya(mean: np.ndarray, cov: np.ndarray, mean0: np.ndarray, cov0: np.ndarray) -> np.ndarray:
    """(K, K0) distances between Gaussians."""
    s = 0.5 * (cov[:, None] + cov0[None])
    det = s[..., 0, 0] * s[..., 1, 1] - s[..., 0, 1] ** 2
    d = mean[:, None] - mean0[None]
    quad = (s[..., 1, 1] * d[..., 0] ** 2 - 2 * s[..., 0, 1] * d[..., 0] * d[..., 1] + s[..., 0, 0] * d[..., 1] ** 2) / det
    own = lambda c: c[:, 0, 0] * c[:, 1, 1] - c[:, 0, 1] ** 2
    return quad / 8.0 + 0.5 * np.log(det / np.sqrt(own(cov)[:, None] * own(cov0)[None]))


class Cells:
    """Cells of the points as candidates for a new component: share, mean and covariance of each."""

    def __init__(self, data: Data, m: int, seed: int):
        label = kmeans(data.x, min(m, len(data.x)), seed, rounds=20)
        size = np.bincount(label, data.w)
        self.mean = np.column_stack([np.bincount(label, data.w * data.x[:, j]) for j in range(2)]) / np.maximum(size, 1e-300)[:, None]
        d = data.x - self.mean[label]
        c = [np.bincount(label, data.w * d[:, i] * d[:, j]) / np.maximum(size, 1e-300) for i, j in ((0, 0), (0, 1), (1, 1))]
        floor = 1e-4 * float(np.trace(data.cov))
        self.cov = np.stack([np.column_stack([c[0] + floor, c[1]]), np.column_stack([c[1], c[2] + floor])], axis=1)
        counts = np.bincount(label)
        ok = (counts >= 5) & (size > 0)
        self.mean, self.cov, self.share = self.mean[ok], self.cov[ok], size[ok] / data.total


def thread_seed(data: Data) -> np.ndarray:
    """A sine wave through the densest ridge: least squares on the two fifths of smallest residual, five times."""
    keep = np.ones(len(data.x), dtype=bool)
    b = np.zeros(3)
    for _ in range(5):
        b = np.linalg.lstsq(data.phi[keep], data.x[keep, 1], rcond=None)[0]
        r = np.abs(data.x[:, 1] - data.phi @ b)
        keep = r <= np.quantile(r, 0.4)
    x = data.x[keep, 0]
    return np.array([x.mean(), max(x.var(), 1e-6), *b, max(float((r[keep] ** 2).mean()), 1e-6)])


def kmeans_start(data: Data, k: int, seed: int) -> Parameters:
    """Weights, means and covariances of k-means++ cells."""
    label = kmeans(data.x, k, seed, rounds=10)
    n = np.maximum(np.bincount(label, minlength=k), 1)
    centre = data.w @ data.x / data.total
    mean = np.array([data.x[label == j].mean(axis=0) if (label == j).any() else centre for j in range(k)])
    cov = np.array([np.cov(data.x[label == j].T, ddof=0) if (label == j).sum() > 3 else data.cov / k for j in range(k)])
    return Parameters(n / n.sum(), mean, cov + 1e-4 * data.cov)


def cold_search(data: Data, k: int, thread: bool, eta: float, seed: int = 0, starts: int = 20, sweeps: int = 5) -> tuple[Parameters, float]:
    """Without a start. Beginnings: by insertion from one Gaussian (with the filament, if there is one) on coarse and on fine cells, the latter
    also with tighter and wider covariances; for Gaussian mixtures also from k-means++ cells and from points drawn at random. They race; the survivors are refined and split
    and merge moves follow. Then each component in turn is taken out and put back where it gains most, as long as that helps."""
    from varloom.operators import mixture_search as search

    centre = data.w @ data.x / data.total
    beginnings = []
    for number, cells in enumerate((Cells(data, 50 * k, seed), Cells(data, 25 * k, seed + 1))):
        p = Parameters(np.array([0.6, 0.4] if thread else [1.0]), centre[None], data.cov[None].copy(), thread_seed(data) if thread else None)
        p = search.greedy(data, p, k, cells)
        if p is not None:
            beginnings += [p, *(search.variants(p) if number else [])]
    if not thread:
        rng = np.random.default_rng(seed)
        drawn = [data.x[rng.choice(len(data.x), k, replace=len(data.x) < k)] for _ in range(starts // 4)]
        beginnings += [kmeans_start(data, k, seed + 100 + s) for s in range(starts)]
        beginnings += [Parameters(np.full(k, 1.0 / k), at, np.tile(data.cov / k, (k, 1, 1))) for at in drawn]
    left = search.race(data, beginnings)
    best = max((search.accelerated(data, p, eta, 400) for _, _, p in left[: max(search.KEEP, 1)]), key=lambda v: v[1])
    if k >= 3:
        best = search.split_merge(data, *best, max(eta, 1e-9))[:2]
    return search.relocated(data, *best, Cells(data, 50 * k, seed + 2), eta, sweeps)


class Mixture:
    """The mixture as a statistic. reference: components that label a cold fit; without it they are sorted by mean."""

    takes_start, eta = True, 1e-10

    def __init__(self, k: int, thread: bool = False, seed: int = 0, reference: Parameters | None = None):
        self.k, self.thread, self.seed, self.reference = k, thread, seed, reference
        self.name = "shearmix" if thread else "gmm"
        self.outputs = names(k, thread)
        self.last_fit: dict | None = None

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return basis(np.asarray(x, dtype=float)[:, 0])

    def fit(self, x: np.ndarray, w: np.ndarray, start: np.ndarray | None = None, eta: float | None = None, prep: np.ndarray | None = None) -> Parameters | None:
        eta = max(eta or self.eta, 1e-12)
        data = Data(np.asarray(x, dtype=float), np.asarray(w, dtype=float), prep)
        if start is not None:
            p = unpacked(np.asarray(start)[: len(names(self.k, self.thread))], self.k, self.thread)
        else:
            p, _ = cold_search(data, self.k, self.thread, 1e-9, self.seed)
            p = self.labelled(p)
        if not p.feasible():
            return None
        p, value, status = finished(data, p, eta)
        self.last_fit = dict(status=status, score=value)
        return p if p.feasible() and status == "converged" else None

    def labelled(self, p: Parameters) -> Parameters:
        if self.reference is not None and self.reference.k == p.k:
            r = self.reference
            col = assignment(bhattacharyya(r.mean, r.cov, p.mean, p.cov))
            return p.permuted(col)
        return p.permuted(np.lexsort((p.mean[:, 1], p.mean[:, 0])))

    def __call__(self, x, w, prep=None, start=None, eta=None) -> np.ndarray:
        try:
            p = self.fit(x, w, start, eta, prep)
            return np.full(len(self.outputs), np.nan) if p is None else self.theta(p)
        except Exception:
            return np.full(len(self.outputs), np.nan)

    def theta(self, p: Parameters) -> np.ndarray:
        return p.vector()

    def loglik(self, x: np.ndarray, w: np.ndarray, theta: np.ndarray) -> float:
        """Penalised log likelihood per unit weight, without a fit."""
        data = Data(np.asarray(x, dtype=float), np.asarray(w, dtype=float))
        return data.log_likelihood(unpacked(theta[: len(names(self.k, self.thread))], self.k, self.thread)) / data.total

    def per_point_loss(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        return -log_density(log_parts(x, basis(x[:, 0]), unpacked(theta[: len(names(self.k, self.thread))], self.k, self.thread)))

    def influence(self, x: np.ndarray, w: np.ndarray | None = None, theta: np.ndarray | None = None) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        w = np.ones(len(x)) if w is None else w
        theta = self(x, w) if theta is None else theta
        nothing = np.full((len(x), len(self.outputs)), np.nan)
        if not np.isfinite(theta).all():
            return nothing
        p = unpacked(theta[: len(names(self.k, self.thread))], self.k, self.thread)
        data, u = Data(x, w), to_free(p)
        h = hessian(data, u, self.k, self.thread)
        if np.linalg.cond(h) > CONDITION_LIMIT:
            return nothing
        s = scores(x, data.phi, p) + penalty_sensitivity(data, u, self.k, self.thread)
        psi_u = -np.linalg.solve(h, (s - w @ s / data.total).T).T * data.total
        return psi_u @ self.jacobian(u).T

    def jacobian(self, u: np.ndarray) -> np.ndarray:
        """Central differences of the outputs in the unconstrained parameters."""
        out = []
        for i in range(len(u)):
            h = 1e-6 * max(1.0, abs(u[i]))
            up, down = u.copy(), u.copy()
            up[i] += h
            down[i] -= h
            d = self.theta(from_free(up, self.k, self.thread)) - self.theta(from_free(down, self.k, self.thread))
            for j, period in getattr(self, "periodic", {}).items():
                at = self.outputs.index(j)
                d[at] = (d[at] + 0.5 * period) % period - 0.5 * period
            out.append(d / (2 * h))
        return np.array(out).T


# One component of interest ------------------------------------------------------------------------------------------------------

DERIVED = ("x", "y", "log_reff", "log_axis_ratio", "pa", "logit_w", "log_contrast")


def derived(p: Parameters, i: int, branch: float = 0.5 * math.pi) -> np.ndarray:
    """Position, a quarter log determinant, log ratio of the eigenvalues (least to largest), position angle, logit weight, and the log ratio of
    the component's peak to the density of the others there. branch: the angle's centre; it is within pi / 2 below and above it, by default
    in [0, pi)."""
    s = p.cov[i]
    lam = np.linalg.eigvalsh(s)
    low = branch - 0.5 * math.pi
    angle = low + (0.5 * math.atan2(2.0 * s[0, 1], s[0, 0] - s[1, 1]) - low) % math.pi
    at = p.mean[i][None]
    parts = log_parts(at, basis(at[:, 0]), p)[0]
    rest = np.delete(parts, i)
    return np.array([*p.mean[i], 0.25 * math.log(lam[0] * lam[1]), math.log(lam[0] / lam[1]), angle, math.log(p.w[i] / (1.0 - p.w[i])), parts[i] - float(log_density(rest[None])[0])])


class CoreMixture(Mixture):
    """A mixture with the derived outputs of the component nearest to a true one; only those are measured."""

    periodic = {"pa": math.pi}

    def __init__(self, k: int, thread: bool, core: tuple[np.ndarray, np.ndarray], seed: int = 0, branch: float = 0.5 * math.pi):
        super().__init__(k, thread, seed)
        self.core, self.branch = core, branch
        self.raw = self.outputs
        self.outputs = self.raw + DERIVED
        self.measured = list(range(len(self.raw), len(self.outputs)))

    def subject(self, p: Parameters) -> int:
        return int(np.argmin(bhattacharyya(p.mean, p.cov, self.core[0][None], self.core[1][None])[:, 0]))

    def theta(self, p: Parameters) -> np.ndarray:
        return np.concatenate([p.vector(), derived(p, self.subject(p), self.branch)])

    def true_derived(self, w: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        from varloom.sources.draws import THREAD, THREAD_SHARE

        p = Parameters(np.append(w, THREAD_SHARE), mean, cov, np.array([THREAD["m"], THREAD["s2x"], *THREAD["b"], THREAD["s2p"]])) if self.thread else Parameters(w, mean, cov)
        return derived(p, self.subject(p), self.branch)


def core_statistic(thread: bool, core: int) -> CoreMixture:
    from varloom.sources.draws import CORES, rotated

    a, b, angle, centre = CORES[core]
    return CoreMixture(4 if thread else 10, thread, (np.array(centre), rotated(a, b, angle)))


def continuation_audit(T: Mixture, x: np.ndarray, w: np.ndarray, truth: np.ndarray) -> dict:
    """Whether the cold search found the likelihood that a continuation from the truth reaches."""
    cold = T(x, w)
    warm = T(x, w, start=truth)
    if not (np.isfinite(cold).all() and np.isfinite(warm).all()):
        return dict(search_gap=math.nan, search_failed=True, search_status="nan")
    gap = T.loglik(x, w, cold) - T.loglik(x, w, warm)
    return dict(search_gap=gap, search_failed=bool(gap < -T.eta * 1e2), search_status="ok")


Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]
