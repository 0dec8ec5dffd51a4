"""Special functions of statistics, for arrays."""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not (df > 0) or math.isnan(t):
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def _fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`_fraction` of each triple, side by side; one that has converged takes no further step."""
    far = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    out, live = np.empty(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1 / far(1 - (a + b) * x / (a + 1))
    product = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / far(1 + top * d), far(1 + top / c)
            product = product * (d * c)
        more = ~(np.abs(d * c - 1) < 1e-14)
        if not more.all():
            out[live[~more]] = product[~more]
            live, a, b, x, c, d, product = (v[more] for v in (live, a, b, x, c, d, product))
        if not len(live):
            break
    out[live] = product
    return out


def t_two_sided_each(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """`t_two_sided` of each pair, side by side."""
    out = np.where((df > 0) & ~np.isnan(t), 0.0, np.nan)
    at = np.flatnonzero((df > 0) & np.isfinite(t))
    with np.errstate(over="ignore", invalid="ignore"):
        a, x = df[at] / 2, df[at] / (df[at] + t[at] * t[at])
        out[at] = x >= 1
        at, a, x = (v[~((x <= 0) | (x >= 1))] for v in (at, a, x))
        b = np.full(len(at), 0.5)
        some, place = np.unique(a, return_inverse=True)
        scale = np.array([math.lgamma(v + 0.5) - math.lgamma(v) - math.lgamma(0.5) for v in some])[place]
        front = np.exp(scale + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        fraction = _fractions(np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x))
        out[at] = np.where(low, front * fraction / a, 1 - front * fraction / b)
    return out


def correlation_p(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Pearson correlations of n pairs."""
    out = []
    for x, k in zip(np.atleast_1d(r), np.atleast_1d(n), strict=True):
        out.append(math.nan if k < 3 or math.isnan(x) else 0.0 if abs(x) >= 1 else t_two_sided(x * math.sqrt((k - 2) / (1 - x * x)), k - 2))
    return np.array(out)
