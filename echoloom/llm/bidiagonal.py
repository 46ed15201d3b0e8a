"""Leading singular vectors of a small square matrix: bidiagonal form, qd iterations, twisted factorisations.

The matrix is the R factor of a whole table, d by d, so all of this is small and runs where it is called.

* ``bidiagonal``: Householder reflections from both sides give an upper bidiagonal matrix.
* ``singular_values``: differential quotient-difference steps with shifts (dqds) on the squares of its entries.
  No step subtracts except by the shift, so small values come out as exactly as large ones.
* ``vectors``: for a value s, the shifted products are factored from the top and from the bottom; the two are
  joined (twisted) at the row where the remaining pivot is smallest, and one solve gives the vector. Values
  that lie close together share a subspace: their vectors start from different rows, and a few rounds of twisted
  solves, each made orthogonal to the others, span it.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: values closer than this part of the largest one are solved together
CLOSE = 1e-6
#: rounds of twisted solves for values that lie together
ROUNDS = 4
MAX_SWEEPS = 60


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V^T and orthogonal V."""
    a = np.array(r, dtype=float)
    d = a.shape[0]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        w = x / size
        w[0] += 1.0 if w[0] >= 0 else -1.0
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k].copy())
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d:
            w = reflector(a[k, k + 1:].copy())
            if w is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds sweep: the arrays of B B^T - shift; None if the shift was too large."""
    d = q[0] - shift
    if d < 0:
        return None
    qq, ee = [], []
    for i in range(len(e)):
        top = d + e[i]
        ratio = q[i + 1] / top if top > 0 else 1.0
        qq.append(top)
        ee.append(e[i] * ratio)
        d = d * ratio - shift
        if not d >= 0:
            return None
    qq.append(d)
    return qq, ee


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix, falling."""
    big = max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(above), initial=0.0))
    if big == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    # segments of (q, e, sum of shifts so far); e has one entry less than q
    todo = [([float(x) ** 2 for x in diagonal / big], [float(x) ** 2 for x in above / big], 0.0)]
    while todo:
        q, e, moved = todo.pop()
        sweeps, limit = 0, MAX_SWEEPS * len(q)
        while q:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            tiny = EPS * EPS
            if e[-1] <= tiny * (moved + q[-1]) or e[-1] == 0.0:      # the last value stands alone
                found.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] == 0.0 or e[i] <= tiny * (moved + q[i])), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if sweeps > limit:
                raise ArithmeticError("the qd iteration does not settle")
            if q[0] < q[-1] and sweeps == 0:                             # the small values belong at the end
                q, e = q[::-1], e[::-1]
            # the smaller value of the last two rows, less what the other rows can take from it; where that is too
            # much, a pivot turns negative and a smaller shift is tried
            total = q[-2] + e[-1] + q[-1]
            root = max((q[-2] - q[-1]) ** 2 + e[-1] * (e[-1] + 2 * (q[-2] + q[-1])), 0.0) ** 0.5
            low = 2 * q[-2] * q[-1] / (total + root)
            made, shift = None, 0.0
            for shift in (low * (1 - min(0.5, 4 * e[-1] / max(q[-2], EPS * EPS))), low * 0.75, low * 0.25, 0.0):
                made = _step(q, e, shift)
                if made is not None:
                    break
            q, e = made
            moved += shift
            sweeps += 1
    return big * np.sqrt(np.sort(np.maximum(np.array(found), 0.0))[::-1])


class Twisted:
    """Both factorisations of B^T B - value and the solve that joins them at a row."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        d, low = diagonal ** 2, above / diagonal[:-1] if n > 1 else above
        small = EPS * max(np.max(d, initial=0.0), value) * EPS
        self.n, self.down, self.up = n, np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        self.plus, self.minus = np.zeros(n), np.zeros(n)
        s, p = np.zeros(n), np.zeros(n)
        s[0] = -value
        for i in range(n - 1):
            self.plus[i] = s[i] + d[i]
            if abs(self.plus[i]) < small:
                self.plus[i] = -small
            self.down[i] = d[i] * low[i] / self.plus[i]
            s[i + 1] = self.down[i] * low[i] * s[i] - value
        self.plus[n - 1] = s[n - 1] + d[n - 1]
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            from_above = d[i] * low[i] ** 2
            if abs(from_above + p[i + 1]) < small:
                p[i + 1] = -small - from_above
            self.minus[i + 1] = from_above + p[i + 1]
            t = d[i] / self.minus[i + 1]
            self.up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        self.minus[0] = p[0]
        self.pivot = s + p + value

    def rows(self) -> np.ndarray:
        """Rows by the size of their pivot, smallest first."""
        return np.argsort(np.abs(self.pivot), kind="stable")

    def vector(self, row: int) -> np.ndarray:
        z = np.zeros(self.n)
        z[row] = 1.0
        for i in range(row - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(row, self.n - 1):
            z[i + 1] = -self.up[i] * z[i]
        size = np.linalg.norm(z)
        return z / size

    def solve(self, right: np.ndarray, row: int) -> np.ndarray:
        """Solution of the shifted system, scaled to length one."""
        y = right.astype(float).copy()
        for i in range(row):                       # from the top to the joining row
            y[i + 1] -= self.down[i] * y[i]
        for i in range(self.n - 2, row - 1, -1):   # from the bottom to it
            y[i] -= self.up[i] * y[i + 1]
        pivots = np.concatenate([self.plus[:row], [self.pivot[row]], self.minus[row + 1:]])
        least = EPS * max(np.max(np.abs(pivots)), EPS)
        pivots = np.where(np.abs(pivots) < least, least, pivots)
        y /= pivots
        for i in range(row - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(row, self.n - 1):
            y[i + 1] -= self.up[i] * y[i]
        size = np.linalg.norm(y)
        return y / size if size > 0 and np.isfinite(size) else right


def _free(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Right singular vectors (columns) of the first ``count`` of the falling ``values``."""
    big = max(values[0], np.max(np.abs(diagonal)), np.max(np.abs(above), initial=0.0))
    a = np.where(np.abs(diagonal) < EPS * big, EPS * big, diagonal)       # moves no value by more than rounding does
    squares, out, first = values ** 2, [], 0
    while first < count:
        last = first + 1
        while last < len(values) and squares[last - 1] - squares[last] <= CLOSE * squares[0]:
            last += 1
        group: list[np.ndarray] = []
        for k in range(first, min(last, count)):
            twisted = Twisted(a, above, squares[k])
            rows = twisted.rows()
            z = twisted.vector(rows[0])
            if last - first > 1:
                seed = np.random.default_rng(k).standard_normal(len(a))
                z = _free(z if k == first else seed, group)
                for _ in range(ROUNDS):
                    z = _free(twisted.solve(z / np.linalg.norm(z), rows[0]), group)
            group.append(z / np.linalg.norm(z))
        out += group
        first = last
    return np.column_stack(out[:count])


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All singular values of ``r``, falling, and the first ``count`` right singular vectors as columns."""
    diagonal, above, v = bidiagonal(r)
    values = singular_values(diagonal, above)
    count = min(count, int(np.sum(values > len(values) * EPS * values[0])) if len(values) and values[0] > 0 else 0)
    if count == 0:
        return values, np.zeros((len(r), 0))
    return values, v @ vectors(diagonal, above, values, count)
