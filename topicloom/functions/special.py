"""ln Gamma and digamma as column expressions and over numpy arrays: recurrence up to 8, then the asymptotic series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8
# Coefficients of the asymptotic series in 1 / x.
_LGAMMA = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188))
_DIGAMMA = ((1, -1 / 2), (2, -1 / 12), (4, 1 / 120), (6, -1 / 252), (8, 1 / 240), (10, -1 / 132))


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0."""
    low = x < _SHIFT
    y = F.when(low, x + _SHIFT).otherwise(x)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi)
    for power, c in _LGAMMA:
        series = series + c / F.pow(y, F.lit(power))
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + i)
    return series - F.when(low, F.log(product)).otherwise(F.lit(0.0))


def digamma(x: Column) -> Column:
    low = x < _SHIFT
    y = F.when(low, x + _SHIFT).otherwise(x)
    series = F.log(y)
    for power, c in _DIGAMMA:
        series = series + c / F.pow(y, F.lit(power))
    steps = F.lit(0.0)
    for i in range(_SHIFT):
        steps = steps + 1 / (x + i)
    return series - F.when(low, steps).otherwise(F.lit(0.0))


def np_digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    low = x < _SHIFT
    y = np.where(low, x + _SHIFT, x)
    out = np.log(y) + sum(c / y**p for p, c in _DIGAMMA)
    safe = np.where(low, x, 1.0)
    return out - np.where(low, sum(1 / (safe + i) for i in range(_SHIFT)), 0.0)


def np_lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    low = x < _SHIFT
    y = np.where(low, x + _SHIFT, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + sum(c / y**p for p, c in _LGAMMA)
    safe = np.where(low, x, 1.0)
    return out - np.where(low, sum(np.log(safe + i) for i in range(_SHIFT)), 0.0)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def clamp_symmetric(x: Column, limit: float = 1e5) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))


def clamp_positive(x: Column, eps: float = 1e-5, limit: float = 1e5) -> Column:
    return F.when(F.isnan(x), eps).otherwise(F.greatest(F.least(x, F.lit(limit)), F.lit(eps)))
