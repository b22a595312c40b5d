"""Tails of Student's t distribution, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(t: float, df: float) -> float:
    """Two-sided; NaN where t is or there are no degrees of freedom."""
    if not math.isfinite(t) or df <= 0:
        return 0.0 if math.isinf(t) and df > 0 else math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """The t that a share 1 - p of both tails together lies beyond."""
    if df <= 0:
        return math.nan
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if p_value(mid, df) > 1 - p else (low, mid)
    return low
