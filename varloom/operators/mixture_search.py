"""The search for a mixture's best optimum: racing starts, insertion of components, splits and merges.

Everything here works on an engine: points in this process (mixture.Data) or a table (table_mixture.TableData). An engine takes one EM step for
many mixtures at once (`em_all`), so that over a table a round of a race, whatever the number of starts, is one aggregation. State that comes
back is of the size of the mixtures, never of the data.

EM gains by a constant factor from some step on; three values in a row then tell its limit (Aitken). On plateaus before an escape that
limit is far too low: of 50 data sets of nine close Gaussians, a race that drops by it alone lost the best start in 35. So it only says
which starts to look at. One is dropped by a bound: where the Hessian is negative definite and the Newton decrement small, the
start is in an optimum's own basin, and twice the quadratic model's gain bounds what it can still reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from varloom.operators.mixture import Parameters, from_free, to_free

#: Starts that a race leaves to be finished; the largest Newton decrement, squared, at which a basin is taken to be quadratic; rounds from one
#: look at a start to the next.
KEEP, BASIN, PATIENCE = 3, 0.01, 6
#: Rounds for which the limit of a candidate's gain is below the leader's before it goes.
LATE = 15
#: Proposals of a split-and-merge cycle, and the displacement of the halves in standard deviations.
BREADTH, OFFSET = 5, 0.5
#: Factors of the covariances of a greedy start's variants.
VARIANTS = (0.25, 4.0)


def remaining(values: Sequence[float]) -> float:
    """The gain that is left after the last of three values: infinite while gains grow, none where there is no more."""
    a, b, c = values[-3:]
    if b - a <= 0.0:
        return 0.0
    rate = (c - b) / (b - a)
    if rate >= 1.0:
        return math.inf
    return 0.0 if rate <= 0.0 else (c - b) * rate / (1.0 - rate)


def limit(engine, p: Parameters) -> float:
    """A bound on what EM or Newton steps from here reach, infinite unless this is an optimum's own basin."""
    value, g, h = engine.information(to_free(p), p.k, p.thread is not None)
    lam, axes = np.linalg.eigh(-0.5 * (h + h.T))
    if not math.isfinite(value) or lam[0] <= 0.0:
        return math.inf
    decrement = float(np.sum((axes.T @ g) ** 2 / lam))
    return value + decrement if decrement <= BASIN else math.inf


def squarem(engine, starts: Sequence[Parameters], longest: list[float]) -> list[tuple[Parameters, float, float]]:
    """A round of squared extrapolation for all starts side by side: three EM steps at most. A jump is kept if it does not lose likelihood, so
    values never fall. longest: the step limits, changed in place. Where each has come, its value, and the gain of one of the EM steps."""
    one = engine.em_all(list(starts))
    two = engine.em_all([p for p, _ in one])
    out, jumps = [(p2, v1, v1 - v0) for (_, v0), (p2, v1) in zip(one, two, strict=True)], []
    for n, (p, (p1, _), (p2, _)) in enumerate(zip(starts, one, two, strict=True)):
        if not (p1.feasible() and p2.feasible()):
            continue
        u0, u1, u2 = to_free(p), to_free(p1), to_free(p2)
        r, v = u1 - u0, u2 - 2 * u1 + u0
        size = float(np.linalg.norm(v))
        step = -min(longest[n], max(1.0, float(np.linalg.norm(r)) / size)) if size > 0 else -1.0
        if step < -1.0:
            with np.errstate(over="ignore"):
                jump = from_free(u0 - 2 * step * r + step * step * v, p.k, p.thread is not None)
            if jump.feasible():
                jumps.append((n, jump, -step))
    if jumps:
        for (n, _, step), (q, v) in zip(jumps, engine.em_all([j for _, j, _ in jumps]), strict=True):
            if math.isfinite(v) and v >= out[n][1] and q.feasible():
                longest[n] *= 4.0 if step >= longest[n] else 1.0
                out[n] = (q, v, out[n][2])
    return out


def race(engine, starts: Sequence[Parameters], keep: int = KEEP, cap: int | None = None) -> list[tuple[float, int, Parameters]]:
    """Accelerated EM on all starts, in rounds. (value, number of the start, where it has come) of those that are left when at most keep are,
    or when all are at their optima, or after cap rounds, best first. A start goes only by its limit() below the best value."""
    live = {k: p for k, p in enumerate(starts) if p.feasible()}
    if not live:
        return []
    history: dict[int, list[float]] = {k: [] for k in live}
    longest, looked, at_rest = dict.fromkeys(live, 4.0), dict.fromkeys(live, 0), set()
    cap = 20 * len(starts[0].vector()) if cap is None else cap
    for n in range(cap):
        moving = [k for k in live if k not in at_rest]
        steps = [longest[k] for k in moving]
        for k, (q, v, _) in zip(moving, squarem(engine, [live[k] for k in moving], steps), strict=True):
            if math.isfinite(v) and q.feasible():
                live[k] = q
                history[k].append(v)
            else:
                del live[k]
        longest.update(zip(moving, steps, strict=True))
        best = max((history[k][-1] for k in live), default=-math.inf)
        for k in [k for k in live if len(history[k]) >= 3 and n - looked[k] >= PATIENCE and k not in at_rest]:
            h = history[k]
            if h[-1] + remaining(h) < best:
                looked[k] = n
                if limit(engine, live[k]) < best:
                    del live[k]
            elif h[-1] - h[-3] <= 1e-9 * max(abs(h[-1]), 1.0):
                at_rest.add(k)
        if len(live) <= keep or len(at_rest) == len(live):
            break
    return sorted(((history[k][-1], k, p) for k, p in live.items() if history[k]), key=lambda v: (-v[0], v[1]))


def scaled_gradient(engine, p: Parameters) -> float:
    """The largest entry of the gradient, means in units of the data's deviation, relative to the value."""
    k, thread = p.k, p.thread is not None
    value, g, _ = engine.information(to_free(p), k, thread)
    free, scale = len(p.w) - 1, np.ones(len(g))
    scale[free : free + 2 * k] = np.tile(np.sqrt(np.diag(engine.cov)), k)
    return float(np.max(np.abs(g) * scale)) / max(abs(value), 1.0)


def accelerated(engine, p: Parameters, eta: float, cap: int, gradient: bool = False) -> tuple[Parameters, float]:
    """Rounds of squarem() until the gain that is left (Aitken) is at most eta of the value and, if asked for, the scaled gradient at most the
    root of eta; cap rounds at most."""
    longest, values = [4.0], []
    for _ in range(cap):
        p, value, step = squarem(engine, [p], longest)[0]
        values.append(value)
        small = eta * max(abs(value), 1.0)
        over = len(values) >= 3 and values[-1] - values[-2] <= small and remaining(values) <= small or step <= 1e-3 * small
        if over and (not gradient or scaled_gradient(engine, p) <= math.sqrt(eta)):
            break
    return p, value


# Insertion ------------------------------------------------------------------------------------------------------------------------


def best_insertion(engine, p: Parameters, cells, eta: float = 1e-6, cap: int = 60) -> tuple[float, Parameters] | None:
    """The cell from which a new component gains the most beside the frozen mixture. Every cell is a candidate; all move together by partial
    EM on (share, mean, covariance). One rests when its gain no longer grows, and leaves when another has come to the same place, from where
    their ways are the same, or when the limit of its gain has been below the leader's gain for LATE rounds. None is dropped by rank."""
    m = len(cells.share)
    if not m:
        return None
    against = engine.against(p)
    share, mean, cov = np.clip(cells.share, 1e-3, 0.5), cells.mean.copy(), cells.cov.copy()
    score, late = np.full(m, -math.inf), np.zeros(m, dtype=int)
    best: tuple[float, float, np.ndarray, np.ndarray] | None = None
    last: list[np.ndarray] = []
    active = np.arange(m)
    sd = np.sqrt(np.diag(engine.cov))
    unit = np.outer(sd, sd)
    for _ in range(cap):
        sums = against(share[active], mean[active], cov[active])
        now = np.full(m, -math.inf)
        now[active] = sums[:, 0] - engine.a * _own_penalty(engine.cov, cov[active])
        score[active] = now[active]
        last = [*last[-2:], now]
        i = int(active[np.argmax(np.where(np.isfinite(now[active]), now[active], -math.inf))])
        if math.isfinite(now[i]) and (best is None or now[i] > best[0]):
            best = float(now[i]), float(share[i]), mean[i].copy(), cov[i].copy()
        n = np.maximum(sums[:, 1], 1e-9)
        share[active] = np.clip(n / engine.total, 1e-6, 0.9)
        mu = sums[:, 2:4] / n[:, None]
        c11, c12, c22 = sums[:, 4] / n - mu[:, 0] ** 2, sums[:, 5] / n - mu[:, 0] * mu[:, 1], sums[:, 6] / n - mu[:, 1] ** 2
        raw = np.stack([np.column_stack([c11, c12]), np.column_stack([c12, c22])], axis=1)
        mean[active] = mu
        cov[active] = (n[:, None, None] * raw + 2 * engine.a * engine.cov) / (n + 2 * engine.a)[:, None, None]
        if len(last) == 3:
            a, b, c = (v[active] for v in last)
            with np.errstate(all="ignore"):
                rate = (c - b) / (b - a)
                left = np.where(b - a <= 0.0, 0.0, np.where(rate >= 1.0, math.inf, np.where(rate <= 0.0, 0.0, (c - b) * rate / (1.0 - rate))))
            late[active] = np.where(c + left < np.nanmax(score), late[active] + 1, 0)
            rests = c - b <= eta * np.maximum(np.abs(c), 1.0)
            place = np.column_stack([np.log(share[active]), mean[active] / sd, (cov[active] / unit).reshape(-1, 4)[:, [0, 1, 3]]])
            first = np.zeros(len(active), dtype=bool)
            first[np.unique(np.round(place, 4), axis=0, return_index=True)[1]] = True
            active = active[~rests & (late[active] < LATE) & np.isfinite(c) & first]
        if not len(active):
            break
    if best is None:
        return None
    gain, s, mu, c = best
    w = np.concatenate([p.w[: p.k] * (1 - s), [s], p.w[p.k :] * (1 - s)])
    return gain, Parameters(w, np.vstack([p.mean, mu]), np.concatenate([p.cov, c[None]]), p.thread)


def _own_penalty(s: np.ndarray, cov: np.ndarray) -> np.ndarray:
    det = cov[:, 0, 0] * cov[:, 1, 1] - cov[:, 0, 1] ** 2
    return (s[0, 0] * cov[:, 1, 1] - 2 * s[0, 1] * cov[:, 0, 1] + s[1, 1] * cov[:, 0, 0]) / det + np.log(det)


def greedy(engine, p: Parameters, k: int, cells) -> Parameters | None:
    """From p, components inserted one by one, each followed by some EM."""
    p, _ = accelerated(engine, p, 1e-6, 30)
    while p.k < k:
        got = best_insertion(engine, p, cells)
        if got is None:
            return None
        p, _ = accelerated(engine, got[1], 1e-6, 10)
    return p


def without(p: Parameters, i: int) -> Parameters:
    w = np.delete(p.w, i)
    return Parameters(w / w.sum(), np.delete(p.mean, i, axis=0), np.delete(p.cov, i, axis=0), p.thread)


def relocated(engine, p: Parameters, value: float, cells, eta: float, sweeps: int = 5) -> tuple[Parameters, float]:
    """Each component in turn is taken out and put back where it gains most, as long as that helps."""
    for _ in range(sweeps if p.k > 1 else 0):
        improved = False
        for i in range(p.k):
            less, _ = accelerated(engine, without(p, i), 1e-6, 8)
            got = best_insertion(engine, less, cells)
            if got is None:
                continue
            trial = accelerated(engine, got[1], 1e-7, 30)
            if trial[1] > value + max(1e-6 * abs(value), 0.1):
                (p, value), improved = accelerated(engine, trial[0], eta, 400), True
        if not improved:
            break
    return p, value


def variants(p: Parameters) -> list[Parameters]:
    """The same means and weights with covariances tighter and wider."""
    return [Parameters(p.w.copy(), p.mean.copy(), p.cov * f, None if p.thread is None else p.thread.copy()) for f in VARIANTS]


# Split and merge --------------------------------------------------------------------------------------------------------------------


def merged(p: Parameters, i: int, j: int) -> tuple[float, np.ndarray, np.ndarray]:
    """One Gaussian with the weight, mean and covariance of two."""
    w = p.w[i] + p.w[j]
    mean = (p.w[i] * p.mean[i] + p.w[j] * p.mean[j]) / w
    spread = [p.cov[c] + np.outer(p.mean[c] - mean, p.mean[c] - mean) for c in (i, j)]
    return w, mean, (p.w[i] * spread[0] + p.w[j] * spread[1]) / w


def proposed(p: Parameters, i: int, j: int, k: int, offset: float = OFFSET) -> Parameters:
    """i and j merged into i's place, k split along its longest axis into k's place and j's."""
    out = Parameters(p.w.copy(), p.mean.copy(), p.cov.copy(), None if p.thread is None else p.thread.copy())
    lam, axis = np.linalg.eigh(p.cov[k])
    step = offset * math.sqrt(max(lam[-1], 0.0)) * axis[:, -1]
    out.w[i], out.mean[i], out.cov[i] = merged(p, i, j)
    out.w[j] = out.w[k] = 0.5 * p.w[k]
    out.mean[k], out.mean[j] = p.mean[k] - step, p.mean[k] + step
    out.cov[j] = p.cov[k]
    return out


def proposals(p: Parameters, merge: np.ndarray, split: np.ndarray, breadth: int = BREADTH) -> list[tuple[int, int, int]]:
    """The most alike pairs, each with the worst fitting component outside it; ties by place, so that labels don't matter."""
    place = np.empty(p.k, dtype=int)
    place[np.lexsort((p.mean[:, 1], p.mean[:, 0]))] = np.arange(p.k)
    pairs = sorted(((-merge[i, j], *sorted((place[i], place[j])), i, j) for i in range(p.k) for j in range(i + 1, p.k)), key=lambda v: v[:3])
    worst = sorted(range(p.k), key=lambda c: (-split[c], place[c]))
    out = [(i, j, next((c for c in worst if c not in (i, j)), None)) for *_, i, j in pairs]
    return [v for v in out if v[2] is not None][:breadth]


def partial(engine, start: list[Parameters], moving: list[tuple[int, ...]], cap: int = 30, eta: float = 1e-5) -> list[Parameters]:
    """EM steps in which only some components of each mixture move, at a constant sum of their weights; all mixtures side by side."""
    now, history = list(start), [[] for _ in start]
    for _ in range(cap):
        open_ = [c for c, h in enumerate(history) if len(h) < 2 or h[-1] - h[-2] > eta * max(abs(h[-1]), 1.0)]
        if not open_:
            break
        for c, (q, v) in zip(open_, engine.em_all([now[c] for c in open_]), strict=True):
            history[c].append(v)
            some, p = list(moving[c]), now[c]
            if not (q.feasible() and math.isfinite(v)):
                history[c] += [-math.inf, -math.inf]
                continue
            w, mean, cov = p.w.copy(), p.mean.copy(), p.cov.copy()
            w[some] = q.w[some] * (p.w[some].sum() / q.w[some].sum())
            mean[some], cov[some] = q.mean[some], q.cov[some]
            now[c] = Parameters(w, mean, cov, p.thread)
    return now


def split_merge(engine, p: Parameters, value: float, eta: float = 1e-9, breadth: int = BREADTH, offset: float = OFFSET, full: Callable | None = None) -> tuple[Parameters, float, int, int]:
    """Split-and-merge moves (Ueda, Nakano, Ghahramani and Hinton, 2000) from an optimum. A cycle ranks pairs by the cosine of their
    responsibilities and components by the divergence of their own points from their Gaussian, makes breadth proposals, moves the three
    components of each by partial EM, races the proposals by EM on all components, and accepts the winner if, after full, it gains more than
    eta. Without gain the moves end. Returns mixture, value, proposals tried and accepted."""
    full = full or (lambda q: accelerated(engine, q, eta, 400))
    tried = accepted = 0
    for _ in range(len(p.vector())):
        merge, split = engine.move_scores(p)
        chosen = proposals(p, merge, split, breadth)
        start = [proposed(p, *c, offset) for c in chosen]
        some = [k for k, q in enumerate(start) if q.feasible()]
        if not some:
            break
        tried += len(some)
        moved = partial(engine, [start[k] for k in some], [chosen[k] for k in some])
        left = race(engine, moved, keep=1, cap=30)
        best = max((full(q) for _, _, q in left[:2]), key=lambda v: v[1], default=None)
        if best is None or not best[0].feasible() or best[1] <= value + eta * max(abs(value), 1.0):
            break
        (p, value), accepted = best, accepted + 1
    return p, value, tried, accepted


def of_sums(sums: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge scores (the cosines of responsibilities) and split scores (the divergence of a component's responsibilities, as a law over the
    points, from its density over them), from sums over points: rr (K, K), and by component r, r log r, r log f and f, f its density."""
    norm = np.sqrt(np.diag(sums["rr"]))
    with np.errstate(all="ignore"):
        merge = np.where(np.outer(norm, norm) > 0.0, sums["rr"] / np.outer(norm, norm), -1.0)
        n = sums["r"]
        split = sums["rlr"] / n - np.log(n) - sums["rlf"] / n + np.log(sums["f"])
    return merge, np.where(np.isfinite(split), split, -math.inf)


