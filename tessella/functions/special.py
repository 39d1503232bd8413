"""Special functions that neither numpy nor Spark has, from their textbook series and continued fractions."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided; df may be infinite."""
    if math.isinf(df):
        return math.erfc(abs(t) / math.sqrt(2))
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return 1 - incomplete_gamma(df / 2, x / 2)


def incomplete_gamma(a: float, x: float) -> float:
    """Lower, regularised."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (-i * (i - a) * d + b)
        c = b - i * (i - a) / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def inverse_trigamma(y: float) -> float:
    """By bisection on a logarithmic scale: trigamma falls."""
    lo, hi = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if trigamma(mid) > y else (lo, mid)
    return math.sqrt(lo * hi)


def studentized_range_tail(q: float, groups: int, df: float) -> float:
    """Of the largest difference of `groups` standard normals over an independent deviation with df degrees of freedom; by Gauss-Legendre sums."""
    import numpy as np

    if q <= 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(160)
    z, wz = 9 * z, 9 * wz
    phi = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    below = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    here = below(z)

    def inside(r: float) -> float:
        return float(groups * (wz * phi * np.clip(here - below(z - r), 0, 1) ** (groups - 1)).sum())

    if math.isinf(df):
        return max(0.0, 1 - inside(q))
    half = df / 2
    spread = 12 / math.sqrt(2 * df)
    s, ws = np.polynomial.legendre.leggauss(120)
    lo, hi = max(0.0, 1 - spread), 1 + spread
    s, ws = (hi - lo) / 2 * s + (hi + lo) / 2, (hi - lo) / 2 * ws
    density = np.exp(half * math.log(half) + math.log(2) - math.lgamma(half) + (df - 1) * np.log(s) - half * s**2)
    return min(1.0, max(0.0, 1 - sum(w * d * inside(q * x) for w, d, x in zip(ws, density, s, strict=True))))
