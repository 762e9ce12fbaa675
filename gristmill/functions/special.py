"""Tail probabilities of the t, F and chi-square distributions (driver-side, on a few numbers)."""

from __future__ import annotations

import math


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1.0 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / max(tiny, 1.0 + term * d, key=abs)
        c = max(tiny, 1.0 + term / c, key=abs)
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * (value - 1.0)


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / max(tiny, an * d + b, key=abs)
        c = max(tiny, b + an / c, key=abs)
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1.0 - front * h


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return 0.0 if math.isinf(t) else beta_share(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    return 0.0 if math.isinf(f) else 1.0 if f <= 0 else beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi_tail(x: float, df: float) -> float:
    return 1.0 if x <= 0 else 1.0 - gamma_share(df / 2, x / 2)


def t_limit(df: float, tail: float = 0.05) -> float:
    """t whose two-sided tail is ``tail``, by halving."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > tail else (low, mid)
    return (low + high) / 2
