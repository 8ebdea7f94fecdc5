"""Normal, t, F and chi-square distribution functions from textbook series (no extra packages)."""

from __future__ import annotations

import math


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _invert(sf, q: float, low: float, high: float) -> float:
    while sf(high) > q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sf(mid) > q:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    return -norm_ppf(1 - p) if p < 0.5 else (0.0 if p == 0.5 else _invert(norm_sf, 1 - p, 0.0, 1.0))


def t_ppf(p: float, df: float) -> float:
    return -t_ppf(1 - p, df) if p < 0.5 else (0.0 if p == 0.5 else _invert(lambda x: t_sf(x, df), 1 - p, 0.0, 1.0))


def f_ppf(p: float, d1: float, d2: float) -> float:
    return _invert(lambda x: f_sf(x, d1, d2), 1 - p, 0.0, 1.0)
