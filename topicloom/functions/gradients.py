"""Values with gradients, for the losses that tasks and driver evaluate over blocks of numpy arrays.

A Var remembers the Vars it was made of and how a gradient passes on to each; backward() walks them once, last first.
"""

from __future__ import annotations

import numpy as np

from .special import np_digamma, np_lgamma

#: Numbers that sums over the entries of Rows hold at a time.
HELD = 1 << 18


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over what broadcasting has repeated."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


class Var:
    __array_priority__ = 1000  # numpy leaves mixed operations to Var

    def __init__(self, value, parents=()):
        self.value, self.parents, self.grad = np.asarray(value, dtype=np.float64), parents, None

    @property
    def shape(self):
        return self.value.shape

    def backward(self, seed=1.0) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        for v in order:
            v.grad = None
        self.grad = np.broadcast_to(np.asarray(seed, dtype=np.float64), self.shape).copy()
        for v in reversed(order):
            for p, back in v.parents:
                g = _fit(back(v.grad), p.shape)
                p.grad = g if p.grad is None else p.grad + g

    def __add__(self, other):
        other = var(other)
        return Var(self.value + other.value, ((self, lambda g: g), (other, lambda g: g)))

    def __mul__(self, other):
        other = var(other)
        return Var(self.value * other.value, ((self, lambda g: g * other.value), (other, lambda g: g * self.value)))

    def __truediv__(self, other):
        other = var(other)
        out = self.value / other.value
        return Var(out, ((self, lambda g: g / other.value), (other, lambda g: -g * out / other.value)))

    def __matmul__(self, other):
        other = var(other)
        return Var(self.value @ other.value, ((self, lambda g: g @ other.value.T), (other, lambda g: self.value.T @ g)))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -var(other)

    def __rsub__(self, other):
        return var(other) + -self

    def __rtruediv__(self, other):
        return var(other) / self

    def __rmatmul__(self, other):
        return var(other) @ self

    __radd__, __rmul__ = __add__, __mul__

    def __getitem__(self, at):
        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, at, g)
            return out

        return Var(self.value[at], ((self, back),))

    def _by(self, value, slope):
        """An elementwise function with its derivative."""
        return Var(value, ((self, lambda g: g * slope),))

    def sum(self, axis=None, keepdims=False):
        grow = lambda g: g if axis is None or keepdims else np.expand_dims(g, axis)
        return Var(self.value.sum(axis=axis, keepdims=keepdims), ((self, lambda g: np.broadcast_to(grow(g), self.shape)),))

    @property
    def T(self):
        return Var(self.value.T, ((self, lambda g: g.T),))


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def exp(x):
    e = np.exp(x.value)
    return x._by(e, e)


def log(x):
    return x._by(np.log(x.value), 1 / x.value)


def sqrt(x):
    r = np.sqrt(x.value)
    return x._by(r, 0.5 / r)


def sigmoid(x):
    s = 0.5 * (1 + np.tanh(0.5 * x.value))
    return x._by(s, s * (1 - s))


def softplus(x):
    return x._by(np.logaddexp(0, x.value), 0.5 * (1 + np.tanh(0.5 * x.value)))


def tanh(x):
    t = np.tanh(x.value)
    return x._by(t, 1 - t * t)


def relu(x):
    return x._by(np.maximum(x.value, 0), x.value > 0)


def clip(x, low, high):
    """Within bounds; beyond them nothing passes on."""
    return x._by(np.clip(x.value, low, high), (x.value >= low) & (x.value <= high))


def lgamma(x):
    return x._by(np_lgamma(x.value), np_digamma(x.value))


def softmax(x, axis=-1):
    e = np.exp(x.value - x.value.max(axis, keepdims=True))
    s = e / e.sum(axis, keepdims=True)
    return Var(s, ((x, lambda g: s * (g - (g * s).sum(axis, keepdims=True))),))


def layer_norm(x, eps=1e-5):
    """Rows with mean 0 and variance 1."""
    centred = x - x.sum(1, keepdims=True) * (1 / x.shape[1])
    return centred / sqrt((centred * centred).sum(1, keepdims=True) * (1 / x.shape[1]) + eps)


class Rows:
    """Rows of few non-zeros each: entry i is val[i] at place idx[i] of row[i]; rows rise."""

    def __init__(self, row: np.ndarray, idx: np.ndarray, val: np.ndarray, shape: tuple[int, int]):
        self.row, self.idx, self.val, self.shape = row, idx, val, shape
        self._by_place = None

    def __getitem__(self, rows) -> Rows:
        if isinstance(rows, slice) and rows == slice(None):
            return self
        place = np.full(self.shape[0], -1)
        place[rows] = np.arange(len(rows))
        mine = np.flatnonzero(place[self.row] >= 0)
        mine = mine[np.argsort(place[self.row[mine]], kind="stable")]
        return Rows(place[self.row[mine]], self.idx[mine], self.val[mine], (len(rows), self.shape[1]))

    def sum(self, axis: int = 1, keepdims: bool = False) -> np.ndarray:
        if axis != 1:
            raise ValueError("rows are summed over their entries only")
        out = np.bincount(self.row, self.val, self.shape[0])
        return out[:, None] if keepdims else out

    def with_values(self, val: np.ndarray) -> Rows:
        return Rows(self.row, self.idx, val, self.shape)

    def over_rows(self, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each row the sum over its entries of their weights times the table's rows of their places."""
        return _combined(self.row, None, self.idx, weights, table, self.shape[0])

    def over_places(self, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each place the sum over its entries of their weights times the table's rows of theirs."""
        if self._by_place is None:
            self._by_place = np.argsort(self.idx, kind="stable")
        return _combined(self.idx[self._by_place], self._by_place, self.row, weights, table, self.shape[1])


def _combined(keys: np.ndarray, order: np.ndarray | None, source: np.ndarray, weights: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """For each of n keys the sum of weights[e] * table[source[e]] over its entries e; keys are those of the entries in order, and rise.

    Keys of about as many entries are worked off together, by small products of matrices in which missing entries weigh 0.
    """
    out, width = np.zeros((n, table.shape[1])), max(table.shape[1], 1)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(first, append=len(keys))
    by = np.argsort(sizes, kind="stable")
    ranked, at = sizes[by], 0
    while at < len(by):
        if ranked[at] * width > HELD:
            for k in by[at:]:
                for s in range(first[k], first[k] + sizes[k], max(1, HELD // width)):
                    e = slice(s, min(s + max(1, HELD // width), first[k] + sizes[k])) if order is None else order[s : min(s + max(1, HELD // width), first[k] + sizes[k])]
                    out[keys[first[k]]] += weights[e] @ table[source[e]]
            break
        longest = min(ranked[at] + ranked[at] // 4, HELD // width)
        to = min(int(np.searchsorted(ranked, longest, "right")), at + max(1, HELD // (int(longest) * width)))
        own = by[at:to]
        place = np.arange(ranked[to - 1])
        there = place < sizes[own, None]
        e = np.where(there, first[own, None] + place, first[own, None])
        e = e if order is None else order[e]
        out[keys[first[own]]] = np.matmul(np.where(there, weights[e], 0.0)[:, None, :], table[source[e]])[:, 0]
        at = to
    return out


def times(x, w: Var) -> Var:
    """x @ w; x is an array or Rows, to which no gradient passes on."""
    if not isinstance(x, Rows):
        return var(x) @ w
    v = w.value
    return Var(x.over_rows(v, x.val), ((w, lambda g: x.over_places(np.ascontiguousarray(g), x.val)),))


def product_at(x: Rows, left: Var, right: Var) -> Var:
    """left @ right at the entries of x: as many numbers as there are entries."""
    a, b = left.value, np.ascontiguousarray(right.value.T)
    step = max(1, HELD // max(a.shape[1], 1))
    value = np.empty(len(x.row))
    for s in range(0, len(value), step):
        value[s : s + step] = np.einsum("ek,ek->e", a[x.row[s : s + step]], b[x.idx[s : s + step]])
    to_left = lambda g: x.over_rows(b, g)
    to_right = lambda g: x.over_places(a, g).T
    return Var(value, ((left, to_left), (right, to_right)))
