"""p-values of two-sample tests, from statistics and sizes."""

from __future__ import annotations

import math

import pandas as pd


def kolmogorov(x: float) -> float:
    """Probability that Kolmogorov's limit distribution exceeds ``x``: of its two series the one that converges fast."""
    if x <= 0:
        return 1.0
    if x < 1:
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 40))
        return 1 - math.sqrt(2 * math.pi) / x * total
    return min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 40)))


def normal_tail(z: float) -> float:
    """Probability that a standard normal variable exceeds ``z``."""
    return math.erfc(z / math.sqrt(2)) / 2


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz) on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def ks_p(ks: float, n: int, m: int) -> float:
    return kolmogorov(math.sqrt(n * m / (n + m)) * ks)


def rank_sum_p(rank_sum: float, ties: float, n: int, m: int) -> float | None:
    """Two-sided; ``ties`` is the sum of t ** 3 - t over the sizes t of groups of equal values. None if all values are equal."""
    size = n + m
    off = rank_sum - n * (n + 1) / 2 - n * m / 2
    var = n * m / 12 * (size + 1 - ties / (size * (size - 1)))
    if var <= 0:
        return None
    z = (off - math.copysign(0.5, off) * (off != 0)) / math.sqrt(var)
    return min(1.0, 2 * normal_tail(abs(z)))


def variance_ratio_p(ratio: float, n: int, m: int) -> float:
    """Two-sided p of the ratio of the variances of ``n`` and ``m`` values."""
    if math.isinf(ratio):
        return 0.0
    a, b = (n - 1) / 2, (m - 1) / 2
    low = incomplete_beta(a * ratio / (a * ratio + b), a, b)
    return min(1.0, 2 * min(low, 1 - low))


def two_sample_p(ks: pd.Series, rank_sum: pd.Series, ties: pd.Series, ratio: pd.Series, n: pd.Series, m: pd.Series) -> pd.DataFrame:
    """The three p of each row, null where a sample is too small or has no variance."""
    out = []
    for d, w, t, f, i, j in zip(ks, rank_sum, ties, ratio, n.astype(int), m.astype(int)):
        some = i > 0 and j > 0
        out.append((ks_p(d, i, j) if some else None, rank_sum_p(w, t, i, j) if some and i + j > 1 else None, variance_ratio_p(f, i, j) if i > 1 and j > 1 and f == f else None))
    return pd.DataFrame(out, columns=["ks_p", "rank_p", "f_p"], dtype="float64")
