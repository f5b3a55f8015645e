"""Steps of the estimators over blocks of cells, in numpy; cells' counts come as non-zeros, zeros are added by matrix products.

A block's counts are Sparse: entry i says that cell row[i] has value val[i] of feature idx[i]. Parameters are features by
topics. Every step is a function of its arguments alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Features whose zeros are added at a time.
BLOCK = 4096


class Sparse(NamedTuple):
    row: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    cells: int

    def of(self, at: np.ndarray) -> Sparse:
        """The entries of the features in `at`, which rise; idx counts within them."""
        if len(at) and at[-1] - at[0] == len(at) - 1:  # no gaps
            mine = np.flatnonzero((self.idx >= at[0]) & (self.idx <= at[-1]))
            return Sparse(self.row[mine], self.idx[mine] - at[0], self.val[mine], self.cells)
        place = np.searchsorted(at, self.idx)
        mine = np.flatnonzero(at[np.minimum(place, len(at) - 1)] == self.idx) if len(at) else np.zeros(0, np.int64)
        return Sparse(self.row[mine], place[mine], self.val[mine], self.cells)


def summed(groups: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Column sums of weights for each of n groups."""
    return np.stack([np.bincount(groups, w, n) for w in weights.T], axis=1) if len(weights) else np.zeros((n, weights.shape[1]))


def softmax(w: np.ndarray) -> np.ndarray:
    e = np.exp(w - w.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _shares(w: np.ndarray) -> np.ndarray:
    """softmax of many rows of few columns, worked off by columns."""
    e = np.ascontiguousarray(w.T)
    e -= e.max(0)
    np.exp(e, out=e)
    e /= e.sum(0)
    return e.T


def added(total: np.ndarray, at: np.ndarray, weights: np.ndarray) -> None:
    """Rows of weights are added to the columns `at` of total: the work is that of the rows, however wide total is."""
    for row, w in zip(total, weights.T, strict=True):
        np.add.at(row, at, w)


def svem_poisson_entries(x: Sparse, e_log_theta: np.ndarray, e_log_rate: np.ndarray, e_rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_ck, responsibilities summed over all features, zeros too; and for each entry its responsibilities times its count.

    The log weight of topic k is E[log theta_ck] + x E[log rate_gk] - E[rate_gk]. Where x is 0 the weights are products of
    a cell's and a feature's, so that their sums over features are two matrix products.
    """
    cell = np.exp(e_log_theta - e_log_theta.max(1, keepdims=True))
    feature = np.exp(e_rate.min(1, keepdims=True) - e_rate)
    n_ck = np.zeros_like(e_log_theta)
    for a in range(0, len(e_rate), BLOCK):
        some = feature[a : a + BLOCK]
        n_ck += cell * ((1 / np.maximum(cell @ some.T, 1e-300)) @ some)
    zero = np.ascontiguousarray((np.take(cell, x.row, 0) * np.take(feature, x.idx, 0)).T)
    zero /= np.maximum(zero.sum(0), 1e-300)
    rho = _shares(np.take(e_log_theta, x.row, 0) + x.val[:, None] * np.take(e_log_rate, x.idx, 0) - np.take(e_rate, x.idx, 0))
    return n_ck + summed(x.row, rho - zero.T, x.cells), (rho.T * x.val).T


def svem_estep_poisson(x: Sparse, e_log_theta: np.ndarray, e_log_rate: np.ndarray, e_rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_ck of svem_poisson_entries and m_gk, its entries summed over cells."""
    n_ck, weights = svem_poisson_entries(x, e_log_theta, e_log_rate, e_rate)
    return n_ck, summed(x.idx, weights, len(e_rate))


def log_shares(a: np.ndarray) -> np.ndarray:
    """log(a_gk / sum_g a_gk)."""
    return np.log(np.maximum(a / a.sum(0, keepdims=True), 1e-32))


def svem_dirichlet_entries(x: Sparse, e_log_theta: np.ndarray, log_phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with log weight E[log theta_ck] + x log_phi_gk; where x is 0 it is softmax(E[log theta])."""
    rho = _shares(np.take(e_log_theta, x.row, 0) + x.val[:, None] * np.take(log_phi, x.idx, 0))
    zeros = len(log_phi) - np.bincount(x.row, minlength=x.cells)
    return softmax(e_log_theta) * zeros[:, None] + summed(x.row, rho, x.cells), (rho.T * x.val).T


def svem_estep_dirichlet(x: Sparse, e_log_theta: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n_ck, weights = svem_dirichlet_entries(x, e_log_theta, log_shares(a))
    return n_ck, summed(x.idx, weights, len(a))


def svem_rate(step: int, kappa: float = 0.6, tau0: float = 1024.0, lr_mult: float = 1.0) -> float:
    return lr_mult * (tau0 + step) ** -kappa


def svem_mstep(a: np.ndarray, b: np.ndarray, m_gk: np.ndarray, n_k: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """One modality's parameters after a step of size rho towards what its cells say."""
    return (1 - rho) * a + rho * (m_gk + 0.1), (1 - rho) * b + rho * (n_k[None, :] + 0.1)


def sharpened(gamma: np.ndarray, penalty: float) -> np.ndarray:
    """Rows with shares raised to 1 / (1 - penalty) and their sums kept."""
    if penalty <= 0:
        return gamma
    total = gamma.sum(1, keepdims=True)
    sharp = np.maximum(gamma / total, 1e-12) ** (1 / (1 - penalty))
    return sharp / sharp.sum(1, keepdims=True) * total


def at_non_zeros(x: Sparse, theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """theta_ck phi_gk at each entry, for all topics."""
    return np.take(theta, x.row, 0) * np.take(phi, x.idx, 0)


def log_rates(x: Sparse, theta: np.ndarray, phi: np.ndarray, least: float = 1e-8) -> float:
    """sum x log(max(theta phi, least))."""
    return float((x.val * np.log(np.maximum(at_non_zeros(x, theta, phi).sum(1), least))).sum())


def expected_entries(x: Sparse, theta: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_ck, and each count shared out over topics by theta_ck phi_gk."""
    p = np.ascontiguousarray(at_non_zeros(x, theta, phi).T)
    p *= x.val / (p.sum(0) + 1e-12)
    return summed(x.row, p.T, x.cells), p.T


def expected_counts(x: Sparse, theta: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_ck and n_gk, the shares summed over cells."""
    n_ck, p = expected_entries(x, theta, phi)
    return n_ck, summed(x.idx, p, len(phi))


def posterior_gamma(n_gk: np.ndarray, mass: np.ndarray, gamma: float, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Shape and rate of a gamma-Poisson modality's rates; mass: topics' sums of theta over cells."""
    return gamma + n_gk, np.broadcast_to(tau + mass[None, :], n_gk.shape)


def inverse_cdf(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row of weights p: the first topic whose cumulated weight reaches the share u of all."""
    c = np.cumsum(p, axis=1)
    return np.minimum((c < u[:, None] * c[:, -1:]).sum(1), p.shape[1] - 1)


def burnin_trace(history, window: int = 20, rtol: float = 1e-4, patience: int = 3, least: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each iteration: how much the mean of the last window differs from that of the window before, relative to it
    (NaN before iteration `least` and until there are two windows); how many differences in a row are below rtol; and
    whether `patience` of them ever were. Fixed values: the defaults.
    """
    v = np.asarray(history, dtype=np.float64)
    at, change = np.arange(max(least, 2 * window), len(v) + 1), np.full(len(v), np.nan)
    before = np.concatenate([[0.0], np.cumsum(v)])
    old, new = (before[at - window] - before[at - 2 * window]) / window, (before[at] - before[at - window]) / window
    change[at - 1] = np.abs(new - old) / (np.abs(old) + 1e-12)
    place = np.arange(len(v))
    streak = place - np.maximum.accumulate(np.where(change < rtol, -1, place)) if len(v) else place
    return change, streak, np.maximum.accumulate(streak >= patience) if len(v) else place > 0
