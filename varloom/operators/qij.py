"""The certified method: the influence variance V = mean psi^2 of any statistic by derivative-free group influences, with a tested
upper limit on its own error, V_hat <= V <= V_hat + U one-sided at the given level.

Four parts, each with one task:

* Field models psi: the interpolant through all measurements, and which of them are constraints.
* Leaves is the table of the groups: points, mean influence, how far that may be off, and whether it was measured or follows from the parent.
* examine() turns one centred Gaussian contrast a leaf into the limit U on the unexplained variance. A contrast's misfit against a model
  that has not seen it has the variance of psi inside the leaf; the misfits' sum follows a law of weighted chi-squares, whose lower
  quantile gives U.
* planned_repairs() and planned_cuts() say what is evaluated next: inferred leaves, where only the evaluations' own error Omega is in the
  way, else the smaller children of the leaves where the model varies most, as many as the forecast asks for.

run() starts from the cells of a quantization and alternates them until U and Omega are within eps of the variance's lower bound on every
output.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from varloom.functions.numerics import chi2_ppf, wchi2_cdf, wchi2_quantile
from varloom.operators.evaluate import Evaluator
from varloom.operators.interpolant import Interpolant, Rows, Span, leverage
from varloom.operators.quantize import build_cells, two_means

DETERMINED_TOL = 1e-8
#: Bytes of kernel columns the driver may hold; a draw that needs more is refused before it starts.
DRIVER_LIMIT = 4 * 1024**3

Vector = tuple[np.ndarray, np.ndarray]


@dataclass
class Result:
    outputs: list[str]
    v_hat: np.ndarray
    u: np.ndarray
    delta: np.ndarray
    v_lb: np.ndarray
    offset: np.ndarray
    evaluations: int
    cells: int
    leaves: int
    rounds: int
    passed: bool
    counts: dict[str, int]
    rounds_table: list[dict]
    leaves_table: list[dict]
    repairs: list[dict]
    n_inferred: int
    eta: float
    bound_eval: np.ndarray
    redundant: int
    eval_error_max: np.ndarray
    timings: dict[str, float]
    psi: np.ndarray
    labels: np.ndarray


def columns_size(n: int, c: int) -> int:
    """Bytes of the kernel columns that n points in c cells may need."""
    return 8 * n * 4 * c


def refuse(n: int, c: int) -> None:
    """An error if n points in c cells need more than the driver's limit."""
    if columns_size(n, c) > DRIVER_LIMIT:
        raise ValueError(f"{n} points by about {4 * c} rows are beyond the driver's limit; draw fewer points")


def mean_of(points: np.ndarray) -> Vector:
    return points, np.full(len(points), 1.0 / len(points))


def explained(terms: np.ndarray, limit: np.ndarray, alpha: float) -> bool:
    """Whether sum / quantile <= limit for every output: the law of the terms, scaled to mean 1, has at most alpha below sum / limit. Its
    quantile is at most 1 and at least that of the largest term alone, which decides most cases without the law."""
    total = terms.sum(axis=0)
    if (total > limit).any():
        return False
    some = np.flatnonzero(total > 0)
    ratio, largest = total[some] / limit[some], terms[:, some].max(axis=0) / total[some]
    open_ = ratio > largest * chi2_ppf(alpha, 1.0)
    worst_first = np.argsort(-ratio[open_], kind="stable")
    return all(wchi2_cdf(terms[:, some[open_][j]], ratio[open_][j]) <= alpha for j in worst_first)


# The model of the influences ----------------------------------------------------------------------------------------------------


class Field:
    """psi as the interpolant has it. A measurement that the constraints already span is not one more of them: the model's error on it, at
    the first fit after it was made, is kept instead."""

    def __init__(self, n: int, label: np.ndarray, size: np.ndarray, x: np.ndarray, scale: np.ndarray):
        self.label, self.size = label, size
        self.rows, self.span, self.interpolant = Rows(n), Span(label, size), Interpolant(x, scale)
        self.error: dict[int, np.ndarray] = {}
        self.unread: list[int] = []
        self.psi = np.empty(0)
        self.changed = True
        self.fit_s = 0.0

    def constrain(self, vector: Vector, value: np.ndarray) -> int:
        """A pilot row: always a constraint."""
        return self.rows.add(*vector, value)

    def offer(self, vector: Vector, value: np.ndarray, recipe: Sequence[tuple[int, float]] | None = None) -> int:
        """recipe: the rows that it is a combination of."""
        spanned, _, residual = self.span.test(*vector)
        row = self.rows.add(*vector, value, active=False)
        if spanned or self.interpolant.kernel_test(row, self.rows, recipe)[0]:
            self.unread.append(row)
        else:
            self.rows.order.append(row)
            self.span.add(row, residual)
            self.changed = True
        return row

    def retire(self, rows: Sequence[int | None]) -> None:
        """A batch begins; these constraints end with it."""
        active = set(self.rows.order)
        ending = [r for r in rows if r in active]
        self.interpolant.begin(ending)
        for r in ending:
            self.span.remove(r)
            self.rows.drop(r)
        self.changed |= bool(ending)

    def settle(self) -> np.ndarray:
        """psi with all that has come in."""
        if self.changed:
            began = time.perf_counter()
            self.psi = self.interpolant.fit(self.rows)
            self.fit_s += time.perf_counter() - began
            self.changed = False
        for r in self.unread:
            self.error[r] = self.rows.value[r] - self.rows.weight[r] @ self.psi[self.rows.index[r]]
        self.unread = []
        return self.psi

    def held_out(self, rows: Sequence[int]) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """The misfit of each row against the model without it, and the direction in which that model differs; None if it is the same."""
        place = {r: i for i, r in enumerate(self.rows.order)}
        misfit, direction = np.empty((len(rows), self.psi.shape[1])), []
        for j, r in enumerate(rows):
            i = place.get(r)
            direction.append(None if i is None else self.interpolant.inverse_column(i))
            misfit[j] = self.error[r] if i is None else self.interpolant.alpha[i] / direction[j][i]
        return misfit, direction

    def determined(self, groups: Sequence[np.ndarray], of: np.ndarray) -> np.ndarray:
        """Whether the constraints leave nothing open inside each group of points; of: each point's group. Only groups that as many
        constraints meet as they have points can be."""
        meets = np.zeros(of.max() + 1, dtype=np.int64)
        for r in self.rows.order:
            meets[np.unique(of[self.rows.index[r]])] += 1
        full = [k for k, points in enumerate(groups) if meets[of[points[0]]] >= len(points)]
        out = np.zeros(len(groups), dtype=bool)
        if full:
            h = leverage(self.label, self.size, self.span, np.concatenate([groups[k] for k in full]))
            starts = np.cumsum([0, *(len(groups[k]) for k in full[:-1])])
            out[full] = np.maximum.reduceat(1.0 - h, starts) <= DETERMINED_TOL
        return out


# The leaves -----------------------------------------------------------------------------------------------------------------------


@dataclass
class Leaves:
    """A column for each property, a place for each leaf; label has each point's leaf."""

    label: np.ndarray
    points: list[np.ndarray]
    mean: list[np.ndarray]
    bound: list[np.ndarray]
    #: The row of a leaf's mean (None for the root) and of its contrast (None without).
    row: list[int | None]
    contrast: list[int | None]
    inferred: list[bool]
    whole: list[bool]

    @classmethod
    def root(cls, n: int, mean: np.ndarray, bound: np.ndarray) -> Leaves:
        return cls(np.zeros(n, dtype=np.int64), [np.arange(n)], [mean], [bound], [None], [None], [False], [False])

    def number(self, points: np.ndarray) -> int:
        return len(points)

    def mean_of(self, points: np.ndarray) -> Vector:
        return mean_of(points)

    def product_with(self, f: np.ndarray) -> Vector:
        """The vector whose evaluation is the mean over all points of psi times f."""
        return np.arange(len(f)), f / len(f)

    def mean_square(self, psi: np.ndarray) -> np.ndarray:
        return (psi**2).mean(axis=0)

    def halves(self, l: int, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        return two_means(psi[self.points[l]], self.points[l])

    @property
    def size(self) -> np.ndarray:
        return np.array([self.number(p) for p in self.points])

    @property
    def share(self) -> np.ndarray:
        return self.size / self.size.sum()

    def squares(self, values: Sequence[np.ndarray]) -> np.ndarray:
        """Mean over the points of a leaf property's square."""
        return (self.share[:, None] * np.array(values) ** 2).sum(axis=0)

    def lower_bound(self, square: np.ndarray, eps: float) -> np.ndarray:
        """What V is at least: the variance between the leaves, or the model's, less what eps allows."""
        return np.maximum(self.squares(self.mean), square / (1.0 + np.sqrt(eps)) ** 2)

    def spread(self, psi: np.ndarray) -> np.ndarray:
        """Share of each leaf times the variance of psi inside it."""
        k, n = len(self.points), np.maximum(self.size, 1)
        columns = []
        for v in psi.T:
            centre = np.bincount(self.label, v, k) / n
            columns.append(np.bincount(self.label, (v - centre[self.label]) ** 2, k) / len(self.label))
        return np.column_stack(columns)

    def divisible(self) -> np.ndarray:
        return (self.size > 1) & ~np.array(self.whole)

    def measured(self, l: int, mean: np.ndarray, bound: np.ndarray, row: int) -> None:
        self.mean[l], self.bound[l], self.row[l], self.inferred[l] = mean, bound, row, False

    def divide(self, l: int, a: np.ndarray, b: np.ndarray, mean: np.ndarray, bound: np.ndarray) -> int:
        """Leaf l becomes its child a, measured; the other child, a new leaf whose number is returned, follows from the parent."""
        n, na, nb = float(self.number(self.points[l])), self.number(a), self.number(b)
        self.points.append(b)
        self.mean.append((n * self.mean[l] - na * mean) / nb)
        self.bound.append((n * self.bound[l] + na * bound) / nb)
        for column, value in ((self.row, None), (self.contrast, None), (self.inferred, True), (self.whole, False)):
            column.append(value)
        self.points[l], self.contrast[l] = a, None
        self.measured(l, mean, bound, -1)
        self.label[b] = len(self.points) - 1
        return len(self.points) - 1


# The test -------------------------------------------------------------------------------------------------------------------------


@dataclass
class Verdict:
    tested: list[int]
    terms: np.ndarray
    determined: np.ndarray
    delta: np.ndarray
    u: np.ndarray
    psi: np.ndarray

    @property
    def total(self) -> np.ndarray:
        return self.terms.sum(axis=0)

    def passes(self, omega: np.ndarray) -> bool:
        return bool(np.all(self.u <= self.delta - omega))


def contrasts(leaves: Leaves, rng: np.random.RandomState) -> Iterator[tuple[int, Vector]]:
    """Centred Gaussian weights for each leaf of several points that has none, in the order of the leaves."""
    for l, points in enumerate(leaves.points):
        if len(points) > 1 and leaves.contrast[l] is None:
            v = rng.standard_normal(len(points))
            yield l, (points, (v - v.mean()) / len(v))


def examine(model: Field, leaves: Leaves, eps: float, alpha: float) -> Verdict:
    """The verdict on the present leaves, whose contrasts are all measured. Nothing is changed."""
    tested = np.flatnonzero(leaves.size > 1).tolist()
    misfit, direction = model.held_out([leaves.contrast[l] for l in tested])
    determined = model.determined([leaves.points[l] for l in tested], leaves.label)
    terms = np.where(determined[:, None], 0.0, (leaves.share * leaves.size)[tested][:, None] * misfit**2)
    psi = model.psi.copy()  # each leaf by the model that did not see its contrast
    for l, e, h, fixed in zip(tested, misfit, direction, determined, strict=True):
        if h is not None and not fixed:
            points = leaves.points[l]
            psi[points] -= np.outer(model.interpolant.influence_on(h, points), e)
    delta = eps * leaves.lower_bound(leaves.mean_square(psi), eps)
    total = terms.sum(axis=0)
    u = np.where(total <= delta, 0.0, np.inf)
    for j in np.flatnonzero((total <= delta) & (total > 0)):
        u[j] = total[j] / max(wchi2_quantile(terms[:, j], alpha), 1e-300)
    if determined.all():
        u[:] = 0.0
    return Verdict(tested, terms, determined, delta, u, psi)


# What is evaluated next -------------------------------------------------------------------------------------------------------------


def planned_repairs(leaves: Leaves, verdict: Verdict, omega: np.ndarray, k: int) -> list[int]:
    """If the test holds but for Omega: the inferred leaves that add most to it, until it would hold, k at most."""
    if not np.all(verdict.u <= verdict.delta):
        return []
    share, part = leaves.share, {}
    for l in np.flatnonzero(leaves.inferred).tolist():
        part[l] = share[l] * leaves.bound[l] ** 2
    out = []
    for l in sorted(part, key=lambda l: -float((part[l] / verdict.delta).max()))[:k]:
        omega = omega - part[l]
        out.append(l)
        if verdict.passes(omega):
            break
    return out


def cuts_needed(verdict: Verdict, omega: np.ndarray, alpha: float, k: int) -> int:
    """How many of the largest terms must go until the rest would pass: 1 to k."""
    room, terms, gone = np.maximum(verdict.delta - omega, 0.0), verdict.terms.copy(), 0
    for j in np.argsort(-(terms / verdict.delta).max(axis=1), kind="stable")[:k]:
        terms[j] = 0.0
        gone += 1
        if (room > 0).all() and explained(terms, room, alpha):
            break
    return max(1, gone)


def planned_cuts(leaves: Leaves, psi: np.ndarray, k: int, enough: Callable[[int, np.ndarray], bool]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, smaller child, other child) of the leaves of the largest spread; enough: whether so many cuts will do, given what spread is
    left in each leaf. Leaves that can't be cut are marked."""
    rest, can, out = leaves.spread(psi), leaves.divisible(), []
    order = np.argsort(-np.where(can, rest.sum(axis=1), -np.inf), kind="stable")
    for l in order[: can.sum()].tolist():
        children = leaves.halves(l, psi)
        if children is None:
            leaves.whole[l] = True
            continue
        out.append((l, *children))
        rest[l] = 0.0
        if len(out) == k or enough(len(out), rest):
            break
    return out


# The run ----------------------------------------------------------------------------------------------------------------------------


@dataclass
class Run:
    """One run's state. All influences are in units of scale, so that outputs weigh alike."""

    evaluate: Evaluator
    model: Field
    leaves: Leaves
    scale: np.ndarray
    own_bound: np.ndarray
    root: list[tuple[int, float]]
    eps: float
    alpha: float
    k: int
    rng: np.random.RandomState
    spent: dict[str, int]
    testing: bool = False
    passed: bool = False
    verdict: Verdict | None = None
    rounds: list[dict] = field(default_factory=list)
    repairs: list[dict] = field(default_factory=list)

    def values(self, vectors: Sequence[Vector], kind: str) -> np.ndarray:
        self.spent[kind] += len(vectors)
        return self.evaluate(vectors) / self.scale

    def total(self) -> int:
        return self.evaluate.base_evaluations + self.evaluate.made

    def omega(self) -> np.ndarray:
        return self.leaves.squares(self.leaves.bound)

    def room(self) -> np.ndarray:
        """What the model itself leaves to the unexplained variance, before any test."""
        return np.maximum(self.eps * self.leaves.lower_bound(self.leaves.mean_square(self.model.psi), self.eps) - self.omega(), 0.0)

    def foreseen(self, spread: np.ndarray, room: np.ndarray) -> bool:
        return bool((room > 0).all()) and explained(spread[self.leaves.size > 1], room, self.alpha)

    def test(self) -> Verdict:
        new = list(contrasts(self.leaves, self.rng))
        if new:
            got = self.values([v for _, v in new], "tests")
            self.model.retire([])
            for (l, v), y in zip(new, got, strict=True):
                self.leaves.contrast[l] = self.model.offer(v, y)
            self.model.settle()
        self.verdict = examine(self.model, self.leaves, self.eps, self.alpha)
        return self.verdict

    def repair(self, which: list[int]) -> None:
        leaves = self.leaves
        got = self.values([leaves.mean_of(leaves.points[l]) for l in which], "repairs")
        self.model.retire([leaves.row[l] for l in which])
        for l, y in zip(which, got, strict=True):
            self.repairs.append(dict(round=len(self.rounds) - 1, leaf=l, n=leaves.number(leaves.points[l]), inferred=leaves.mean[l] * self.scale, measured=y * self.scale, bound=leaves.bound[l] * self.scale))
            leaves.measured(l, y, self.own_bound.copy(), self.model.offer(leaves.mean_of(leaves.points[l]), y))

    def cut(self, cuts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        leaves = self.leaves
        got = self.values([leaves.mean_of(a) for _, a, _ in cuts], "splits")
        self.model.retire([leaves.row[l] for l, _, _ in cuts])
        for (l, a, b), y in zip(cuts, got, strict=True):
            parent, n, na, nb = leaves.row[l], float(leaves.number(leaves.points[l])), leaves.number(a), leaves.number(b)
            other = leaves.divide(l, a, b, y, self.own_bound.copy())
            leaves.row[l] = self.model.offer(leaves.mean_of(a), y)
            of_parent = [(r, w * n / nb) for r, w in (self.root if parent is None else [(parent, 1.0)])]
            leaves.row[other] = self.model.offer(leaves.mean_of(b), leaves.mean[other], [*of_parent, (leaves.row[l], -na / nb)])

    def advance(self, progress: Callable[[dict], None] | None) -> bool:
        """One round; whether another may follow."""
        psi = self.model.settle()
        if not self.leaves.divisible().any():
            return False
        omega, room = self.omega(), None
        if not self.testing:
            room = self.room()
            self.testing = self.foreseen(self.leaves.spread(psi), room)
        verdict = self.test() if self.testing else None
        in_units = lambda v: None if v is None else v * self.scale**2
        line = dict(round=len(self.rounds), phase="test" if verdict else "pre", n_taken=0, n_repaired=0, E=self.total(), K=len(self.leaves.points), offset=in_units(omega), R_hat=in_units(verdict and verdict.total), U=in_units(verdict and verdict.u), delta=in_units(verdict and verdict.delta))
        self.rounds.append(line)
        if progress is not None:
            progress(line)
        if verdict and verdict.passes(omega):
            self.passed = True
            return False
        again = planned_repairs(self.leaves, verdict, omega, self.k) if verdict else []
        if again:
            self.repair(again)
            line.update(n_repaired=len(again), E=self.total())
            return True
        if verdict:
            need = cuts_needed(verdict, omega, self.alpha, self.k)
            cuts = planned_cuts(self.leaves, self.model.psi, self.k, lambda n, rest: n >= need)
        else:
            cuts = planned_cuts(self.leaves, psi, self.k, lambda n, rest: self.foreseen(rest, room))
        if cuts:
            self.cut(cuts)
            line.update(n_taken=len(cuts), E=self.total())
        return bool(cuts)


def run(T, x: np.ndarray, *, eps: float = 0.01, level: float = 0.84, cells: int | None = None, k: int = 16, seed: int = 0, spark: SparkSession | None = None, exact: Callable | None = None, labels: np.ndarray | None = None, transform=None, scale: np.ndarray | None = None, progress: Callable[[dict], None] | None = None) -> Result:
    """The method on one draw x, (N,) or (N, d). k: most splits in a round, part of the definition of a run. exact: evaluations from known
    influences. labels: the pilot's cells, where they are given."""
    if not 0.0 < 1.0 - level <= 0.5 or k < 1:
        raise ValueError("level must be in [0.5, 1) and k at least 1")
    clock = [time.perf_counter()]
    x = np.asarray(x, dtype=float)
    n, evaluate = len(x), Evaluator(T, x, spark, exact)
    outputs = [str(T.outputs[j]) for j in evaluate.measured]
    q = len(outputs)
    clock.append(time.perf_counter())
    pilot = build_cells(x, cells, eps, q, seed, transform, labels)
    c, share, vectors = len(pilot.size), pilot.size / n, pilot.weights()
    refuse(n, c)
    clock.append(time.perf_counter())
    measured = evaluate(vectors)
    clock.append(time.perf_counter())
    s = np.sqrt(np.maximum((share[:, None] * measured**2).sum(axis=0), 1e-300)) if scale is None else np.asarray(scale, dtype=float)
    own_bound = np.full(q, 0.0 if exact is not None else np.sqrt(evaluate.eta))
    model = Field(n, pilot.label, pilot.size, pilot.x, pilot.point_scale)
    root = [(model.constrain(v, y), float(w)) for v, y, w in zip(vectors, measured / s, share, strict=True)]
    leaves = Leaves.root(n, (share[:, None] * measured / s).sum(axis=0), own_bound.copy())
    spent = dict(base=evaluate.base_evaluations, pilot=c, splits=0, tests=0, repairs=0, report=q)
    state = Run(evaluate, model, leaves, s, own_bound, root, eps, 1.0 - level, k, np.random.RandomState(seed), spent)
    while state.advance(progress):
        pass
    return report(state, outputs, c, clock)


def report(state: Run, outputs: list[str], cells: int, clock: list[float]) -> Result:
    """V_hat = 2 mean(psi psi_hat) - mean(psi_hat^2), the product by one evaluation an output, with the psi_hat that was tested last."""
    s, leaves, verdict, q = state.scale, state.leaves, state.verdict, len(outputs)
    model_psi = state.model.settle()
    psi = (model_psi if verdict is None else verdict.psi) * s
    product = np.diag(state.evaluate([leaves.product_with(psi[:, j]) for j in range(q)])).copy()
    square = leaves.mean_square(psi)
    if state.total() != sum(state.spent.values()):
        raise AssertionError(f"{state.total()} evaluations made, {state.spent} counted")
    delta = (state.eps * leaves.lower_bound(square / s**2, state.eps) if verdict is None else verdict.delta) * s**2
    errors = np.array(list(state.model.error.values())).reshape(-1, q)
    term = {} if verdict is None else {l: (t * s**2, bool(d)) for l, t, d in zip(verdict.tested, verdict.terms, verdict.determined, strict=True)}
    untested = (np.zeros(q), False)
    table = [dict(leaf=l, n=leaves.number(points), mean=leaves.mean[l] * s, bound=leaves.bound[l] * s, inferred=leaves.inferred[l], term=term.get(l, untested)[0], determined=term.get(l, untested)[1]) for l, points in enumerate(leaves.points)]
    return Result(
        outputs=outputs, v_hat=2.0 * product - square, u=np.full(q, np.inf) if verdict is None else verdict.u * s**2, delta=delta, v_lb=delta / state.eps, offset=state.omega() * s**2,
        evaluations=state.total(), cells=cells, leaves=len(leaves.points), rounds=len(state.rounds), passed=state.passed, counts=state.spent, rounds_table=state.rounds, leaves_table=table,
        repairs=state.repairs, n_inferred=sum(leaves.inferred), eta=state.evaluate.eta, bound_eval=state.own_bound * s, redundant=len(errors), eval_error_max=np.abs(errors).max(axis=0) if len(errors) else np.zeros(q),
        timings=dict(cells_s=clock[2] - clock[1], pilot_s=clock[3] - clock[2], fit_s=state.model.fit_s, total_s=time.perf_counter() - clock[0]), psi=psi, labels=leaves.label,
    )
