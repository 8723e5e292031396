"""The influence model of the certified method: the minimum-norm function in a kernel space that meets linear constraints.

Constraints are sparse rows a over the points, with measured values y: a psi = y. With kernel K, psi = K A' alpha, where
(A K A' + jitter) alpha = y. Two rules keep redundant rows out: a row (nearly) in the span of the active rows, and a row whose kernel
column is (nearly) in the span of theirs. It runs on the driver: the points are one draw, whose size run() bounds.

The Gram matrix A K A' is never inverted anew: a whitening W, with W'W its inverse, gains a row for each constraint that enters and is turned by
one reflection for each that leaves, so that a round costs what changes in it. What a candidate adds is its own norm less that of its
whitened products with the constraints there are; the same numbers are its row of W.
"""

from __future__ import annotations

import numpy as np

from varloom.functions.numerics import pivoted_cholesky

#: Entries of a temporary kernel block and of a block of rows' products; tolerances of the two rules and of the reproduction of constraints.
BLOCK, ENTRIES = 1 << 16, 1 << 22
#: Largest exponent within a group up to which running sums are taken.
SPREAD = 300.0
SPAN_TOL = KERNEL_TOL = REPRODUCTION_TOL = 1e-8
JITTER = 1e-10


class Rows:
    """The constraint rows by id: support, weights, value; the active ones in order."""

    def __init__(self, n: int):
        self.n, self.index, self.weight, self.value, self.order = n, [], [], [], []

    def add(self, index: np.ndarray, weight: np.ndarray, value: np.ndarray, active: bool = True) -> int:
        self.index.append(np.asarray(index, dtype=np.int64))
        self.weight.append(np.asarray(weight, dtype=float))
        self.value.append(np.asarray(value, dtype=float))
        if active:
            self.order.append(len(self.index) - 1)
        return len(self.index) - 1

    def drop(self, row: int) -> None:
        self.order.remove(row)

    def values(self) -> np.ndarray:
        return np.array([self.value[r] for r in self.order])

    def flat(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Supports and weights end to end, and where each begins."""
        sizes = [len(self.index[r]) for r in which]
        return np.concatenate([self.index[r] for r in which]), np.concatenate([self.weight[r] for r in which]), np.cumsum([0, *sizes[:-1]])

    def apply(self, f: np.ndarray, which=None) -> np.ndarray:
        """Each row times f (N, k)."""
        which = self.order if which is None else which
        if not len(which):
            return np.zeros((0, f.shape[1]))
        i, w, at = self.flat(which)
        out, step = np.empty((len(which), f.shape[1])), max(1, ENTRIES // len(i))
        for a in range(0, f.shape[1], step):
            part = np.ascontiguousarray(f[:, a : a + step])[i]
            part *= w[:, None]
            out[:, a : a + step] = np.add.reduceat(part, at, axis=0)
        return out


class Span:
    """Whether a row lies in the span of the active rows. Rows are taken relative to their cell means, which the pilot rows span; the
    Gram matrix of the residuals is factored anew after a removal, and grown by a row otherwise."""

    def __init__(self, label: np.ndarray, size: np.ndarray):
        self.label, self.size = label, size.astype(float)
        order, ends = np.argsort(label, kind="stable"), np.cumsum(size)
        self.members = [order[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.ids: list[int] = []
        self.low = np.zeros((0, 0))

    def residual(self, index: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = np.bincount(self.label[index], weight, len(self.size)) / self.size
        cells = np.flatnonzero(mean)
        at = np.unique(np.concatenate([index, *(self.members[c] for c in cells)]))
        r = -mean[self.label[at]]
        r[np.searchsorted(at, index)] += weight
        return at, r

    def test(self, index: np.ndarray, weight: np.ndarray) -> tuple[bool, float, tuple]:
        at, r = self.residual(index, weight)
        dense = np.zeros(len(self.label))
        dense[at] = r
        left = float(r @ r)
        g = np.array([self.rows[k][1] @ dense[self.rows[k][0]] for k in self.ids])
        x = np.linalg.solve(self.low, g) if len(g) else g
        left -= float(x @ x)
        share = max(left, 0.0) / float(weight @ weight)
        return share <= SPAN_TOL, share, (at, r, x, left)

    def add(self, row: int, data: tuple) -> None:
        at, r, x, left = data
        k = len(self.ids)
        low = np.zeros((k + 1, k + 1))
        low[:k, :k], low[k, :k], low[k, k] = self.low, x, np.sqrt(left)
        self.low, self.rows[row] = low, (at, r)
        self.ids.append(row)

    def remove(self, row: int) -> None:
        k = self.ids.index(row)
        keep = [i for i in range(len(self.ids)) if i != k]
        gram = (self.low @ self.low.T)[np.ix_(keep, keep)]
        self.ids.pop(k)
        self.rows.pop(row)
        self.low = np.linalg.cholesky(gram) if keep else np.zeros((0, 0))


class Whitening:
    """W with W'W the inverse of a Gram matrix whose rows come and go. W is triangular only until a row leaves, and needs not be."""

    def __init__(self, gram: np.ndarray | None = None):
        self.size = 0
        self._store = np.zeros((16, 16))
        if gram is not None and len(gram):
            self.size = len(gram)
            self._store = np.zeros((2 * self.size, 2 * self.size))
            self._store[: self.size, : self.size] = np.linalg.inv(np.linalg.cholesky(gram))

    @property
    def w(self) -> np.ndarray:
        return self._store[: self.size, : self.size]

    def whitened(self, products: np.ndarray) -> np.ndarray:
        return self.w @ products

    def append(self, white: np.ndarray, left: float) -> None:
        """white: the whitened products of the new row with the others; left: what its norm exceeds theirs by."""
        k = self.size
        if k == len(self._store):
            grown = np.zeros((2 * k, 2 * k))
            grown[:k, :k] = self._store
            self._store = grown
        root = np.sqrt(left)
        self._store[k, :k] = -(white @ self.w) / root
        self._store[:k, k] = 0.0
        self._store[k, k] = 1.0 / root
        self.size += 1

    def remove(self, k: int) -> None:
        """A reflection leaves column k nothing but its last entry; then the last row and column k go."""
        w, v = self.w, self.w[:, k].copy()
        v[-1] += np.copysign(np.linalg.norm(v), v[-1])
        w -= np.outer(v, (2.0 / (v @ v)) * (v @ w))
        last = self.size - 1
        w[:, k:last] = w[:, k + 1 :].copy()
        self.size = last

    def solve(self, y: np.ndarray) -> np.ndarray:
        return self.w.T @ (self.w @ y)

    def inverse_column(self, k: int) -> np.ndarray:
        return self.w.T @ self.w[:, k]


class Interpolant:
    def __init__(self, x: np.ndarray, scale: np.ndarray):
        self.x, self.scale, self.half = np.ascontiguousarray(x), scale, 0.5 * scale**2
        self.square, (self.n, self.d) = (x**2).sum(axis=1), x.shape
        self.columns: dict[int, np.ndarray] = {}
        self.ids: list[int] = []
        self.jitter = 0.0
        self.alpha = None
        self.white = Whitening()
        self.place_of: np.ndarray = np.empty(0, dtype=np.int64)
        self.pending: dict[int, np.ndarray] = {}
        if self.d == 1:  # groups of one scale, each sorted by place
            by = np.lexsort((self.x[:, 0], self.scale))
            self.groups = np.split(by, np.flatnonzero(np.diff(self.scale[by])) + 1)
            self.group = np.empty(self.n, dtype=np.int64)
            self.place = np.empty(self.n, dtype=np.int64)
            self.place[by] = np.arange(self.n)
            for g, members in enumerate(self.groups):
                self.group[members] = g

    def kernel(self, i: np.ndarray, low: int, high: int) -> np.ndarray:
        """exp(-sqrt(2 D^2 / S)) (2 s_i s_j / S)^(d/2), S = s_i^2 + s_j^2; a point's distance to itself is exactly 0."""
        d2 = self.x[i] @ self.x[low:high].T
        d2 *= -2.0
        d2 += self.square[i][:, None]
        d2 += self.square[None, low:high]
        np.maximum(d2, 0.0, out=d2)
        own = np.flatnonzero((i >= low) & (i < high))
        d2[own, i[own] - low] = 0.0
        s = self.half[i][:, None] + self.half[None, low:high]
        d2 /= s
        np.sqrt(d2, out=d2)
        np.negative(d2, out=d2)
        np.exp(d2, out=d2)
        np.divide(self.scale[i][:, None] * self.scale[None, low:high], s, out=s)
        for _ in range(self.d // 2):  # s ** (d / 2) without a general power
            d2 *= s
        if self.d % 2:
            d2 *= np.sqrt(s, out=s)
        return d2

    def column_1d(self, index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """column() in one dimension, without its n^2 kernel entries: between two groups of one scale each, the kernel is
        c exp(-r |x - y|), whose sum over the points on either side is a running sum over the sorted points."""
        out = np.zeros(self.n)
        order = np.argsort(self.place[index])
        index, weight = index[order], weight[order]
        for part in np.split(np.arange(len(index)), np.flatnonzero(np.diff(self.group[index])) + 1):
            i, w = index[part], weight[part]
            x, s = self.x[i, 0], self.scale[i[0]]
            for to in self.groups:
                y, t = self.x[to, 0], self.scale[to[0]]
                square = 0.5 * (s * s + t * t)
                r, c = 1.0 / np.sqrt(square), np.sqrt(s * t / square)
                if y[0] >= x[-1]:
                    out[to] += c * (w @ np.exp(r * (x - x[-1]))) * np.exp(r * (x[-1] - y))
                elif y[-1] <= x[0]:
                    out[to] += c * (w @ np.exp(r * (x[0] - x))) * np.exp(r * (y - x[0]))
                elif r * (x[-1] - x[0]) <= SPREAD:
                    at = np.searchsorted(x, y, side="right")
                    low = np.concatenate([[0.0], np.cumsum(w * np.exp(r * (x - x[-1])))])[at]
                    high = np.concatenate([np.cumsum((w * np.exp(r * (x[0] - x)))[::-1])[::-1], [0.0]])[at]
                    some, rest = at > 0, at < len(x)
                    out[to[some]] += c * low[some] * np.exp(r * (x[-1] - y[some]))
                    out[to[rest]] += c * high[rest] * np.exp(r * (y[rest] - x[0]))
                else:  # running sums would leave the range of numbers
                    step = max(1, BLOCK // len(x))
                    for a in range(0, len(to), step):
                        out[to[a : a + step]] += c * (w @ np.exp(-r * np.abs(x[:, None] - y[None, a : a + step])))
        return out

    def column(self, index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if self.d == 1 and len(index):
            return self.column_1d(index, weight)
        out, step = np.empty(self.n), max(1, BLOCK // max(1, len(index)))
        for low in range(0, self.n, step):
            high = min(self.n, low + step)
            out[low:high] = weight @ self.kernel(index, low, high)
        return out

    def column_of(self, row: int, rows: Rows, recipe: list[tuple[int, float]] | None) -> np.ndarray:
        """A row's kernel column: from the columns it is a combination of, where they are known, else from the points."""
        if recipe is not None:
            known = [self.pending.get(k, self.columns.get(k)) for k, _ in recipe]
            if all(c is not None for c in known):
                return sum(c * a for c, (_, a) in zip(known, recipe, strict=True))
        return self.column(rows.index[row], rows.weight[row])

    # Rows that ask to enter between two fits --------------------------------------------------------------------------------

    def begin(self, leaving: list[int]) -> None:
        """A batch starts; the rows that leave with it are known before the first candidate. Their columns stay until the next fit, since
        candidates may be combinations of them."""
        self.pending = {}
        for r in leaving:
            if r in self.ids:
                self._leave(r)

    def _leave(self, row: int) -> None:
        k = self.ids.index(row)
        self.white.remove(k)
        self.ids.pop(k)

    def kernel_test(self, row: int, rows: Rows, recipe=None) -> tuple[bool, float]:
        """Whether a row adds nothing to the rows there are, those of the last fit that stay and those accepted since: whether what is left of its
        norm is within KERNEL_TOL of the norm, or within 100 times the jitter. If not it becomes one of them."""
        column = self.column_of(row, rows, recipe)
        norm = float(rows.weight[row] @ column[rows.index[row]])
        left, white = self._left(column, norm, rows)
        adds = left > max(KERNEL_TOL * norm, 100.0 * self.jitter)
        if adds:
            self._enter(row, white, left)
            self.pending[row] = column
        return not adds, left / norm if norm > 0 else 0.0

    def _left(self, column: np.ndarray, norm: float, rows: Rows) -> tuple[float, np.ndarray]:
        white = self.white.whitened(rows.apply(column[:, None], self.ids)[:, 0]) if self.ids else np.zeros(0)
        return norm - float(white @ white), white

    def _enter(self, row: int, white: np.ndarray, left: float) -> None:
        self.white.append(white, left + self.jitter)
        self.ids.append(row)

    # The fit ------------------------------------------------------------------------------------------------------------------

    def fit(self, rows: Rows) -> np.ndarray:
        """psi through all active rows. Columns come from the batch's candidates where they are known; rows that were never tested, as the
        pilot's, are factored together if they are the first, and enter one by one otherwise."""
        order = list(rows.order)
        late = [r for r in order if r not in self.columns and r not in self.pending]
        if late:
            self._columns(late, rows)
        self.columns.update({r: self.pending[r] for r in order if r in self.pending})
        stays = set(order)
        for r in [r for r in self.columns if r not in stays]:
            del self.columns[r]
        for r in [r for r in self.ids if r not in stays]:
            self._leave(r)
        if not self.ids:
            self._factor(order, rows)
        there = set(self.ids)
        for r in [r for r in order if r not in there]:
            left, white = self._left(self.columns[r], float(rows.weight[r] @ self.columns[r][rows.index[r]]), rows)
            self._enter(r, white, max(left, 0.0))
        y = rows.values()
        psi, miss, tol = self._solved(order, rows, y)
        if miss > tol:  # rounding has gathered in the whitening
            self._factor(order, rows)
            psi, miss, tol = self._solved(order, rows, y)
        if miss > tol:
            raise RuntimeError(f"the interpolant misses its constraints by {miss:.3g}, more than {tol:.3g}")
        self.pending = {}
        return psi

    def _factor(self, order: list[int], rows: Rows) -> None:
        """The whitening of the whole Gram matrix."""
        gram = rows.apply(np.array([self.columns[r] for r in order]).T, order)
        gram = 0.5 * (gram + gram.T)
        if not self.jitter:
            self.jitter = JITTER * max(float(gram.diagonal().max()), 1e-300)
        gram[np.diag_indices(len(order))] += self.jitter
        self.white, self.ids = Whitening(gram), list(order)

    def _solved(self, order: list[int], rows: Rows, y: np.ndarray) -> tuple[np.ndarray, float, float]:
        """psi, the largest miss of a constraint after up to three corrections, and what is allowed. Coefficients are in the rows' own order."""
        c = np.array([self.columns[r] for r in order])
        self.columns = dict(zip(order, c, strict=True))  # views: the columns are held once
        self._matrix = c
        at = {r: k for k, r in enumerate(order)}
        #: For each row of the whitening its place in the rows' order.
        self.place_of = np.array([at[r] for r in self.ids], dtype=np.int64)
        alpha, left = np.zeros_like(y), y
        tol = REPRODUCTION_TOL * max(1.0, float(np.abs(y).max()))
        psi, miss = np.zeros((self.n, y.shape[1])), np.inf
        for _ in range(4):
            alpha[self.place_of] += self.white.solve(left[self.place_of])
            psi = c.T @ alpha
            left = y - rows.apply(psi, order)
            miss = float(np.abs(left).max())
            if miss <= tol:
                break
        self.alpha = alpha
        return psi, miss, tol

    def inverse_column(self, i: int) -> np.ndarray:
        """A column of the inverse Gram matrix, both in the order of the rows of the last fit."""
        out = np.empty(len(self.place_of))
        out[self.place_of] = self.white.inverse_column(int(np.flatnonzero(self.place_of == i)[0]))
        return out

    def _columns(self, which: list[int], rows: Rows) -> None:
        """Columns of many rows at once: one kernel block over the union of their supports at a time."""
        if self.d == 1:
            for r in which:
                self.columns[r] = self.column(rows.index[r], rows.weight[r])
            return
        support = np.unique(np.concatenate([rows.index[r] for r in which]))
        out = np.empty((len(which), self.n))
        step = max(1, BLOCK // len(support))
        i, w, at = rows.flat(which)
        place = np.searchsorted(support, i)
        for low in range(0, self.n, step):
            high = min(self.n, low + step)
            k = self.kernel(support, low, high)
            out[:, low:high] = np.add.reduceat(k[place] * w[:, None], at, axis=0)
        for r, c in zip(which, out, strict=True):
            self.columns[r] = c

    def influence_on(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """x' (K A') at the points."""
        return x @ self._matrix[:, points]


def leverage(label: np.ndarray, size: np.ndarray, span: Span, points: np.ndarray) -> np.ndarray:
    """The squared norm of the projection of each point's indicator onto the space of the active rows: 1 / n of its cell, and its part
    in the residuals of the other rows, by a Cholesky factor with pivoting."""
    out = 1.0 / size[label[points]]
    if not span.ids:
        return out
    dense = np.zeros((len(span.ids), len(label)))
    for k, r in enumerate(span.ids):
        at, v = span.rows[r]
        dense[k, at] = v
    low, piv, rank = pivoted_cholesky(dense @ dense.T)
    if rank:
        z = np.linalg.solve(low[:rank, :rank], dense[piv[:rank]][:, points])
        out = out + (z**2).sum(axis=0)
    return out
