"""Upper tails of the chi-square and F distributions, by continued fractions; a few per feature, on the driver."""

from __future__ import annotations

import math

_TINY = 1e-300


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1 / _TINY
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = c * d
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            step = c * d
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h / a


def chi_square(statistic: float, dof: float) -> float:
    return 1.0 if dof <= 0 else _gamma_upper(dof / 2, statistic / 2)


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isnan(f):
        return math.nan
    if f == math.inf:
        return 0.0
    return 1.0 if f <= 0 else _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
