"""Distribution functions on arrays, and the two-sided Kolmogorov distribution (no SciPy in the image).

The incomplete gamma and beta functions run until every element has settled, so large shapes are as exact as small ones.
"""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-300
EPS = 1e-15


def _log_gamma_lead(a: float, x: np.ndarray) -> np.ndarray:
    return a * np.log(x) - x - math.lgamma(a)


def gamma_cdf(a: float, x) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x); 0 for x <= 0."""
    x = np.asarray(x, float)
    out = np.where(x == np.inf, 1.0, 0.0)
    low = (x > 0) & (x < a + 1)
    if low.any():
        z = x[low]
        term = np.full(len(z), 1.0 / a)
        total, n = term.copy(), 0
        while (term > EPS * total).any():  # falling terms: x < a + 1
            n += 1
            term = term * z / (a + n)
            total += term
        out[low] = total * np.exp(_log_gamma_lead(a, z))
    high = (x >= a + 1) & (x < np.inf)
    if high.any():
        z = x[high]
        b = z + 1 - a
        c, d = np.full(len(z), 1 / TINY), 1 / b
        h, change, i = d.copy(), np.full(len(z), 2.0), 0
        while (np.abs(change - 1) > EPS * 10).any() and i < 1_000_000:
            i += 1
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            change = c * d
            h = h * change
        out[high] = 1 - np.exp(_log_gamma_lead(a, z)) * h
    return np.clip(out, 0.0, 1.0)


def norm_cdf(z) -> np.ndarray:
    z = np.asarray(z, float)
    half = 0.5 * gamma_cdf(0.5, z * z / 2)
    return np.where(z >= 0, 0.5 + half, 0.5 - half)


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h, m, change = d.copy(), 0, np.full(len(x), 2.0)
    while (np.abs(change - 1) > EPS * 10).any() and m < 1_000_000:
        m += 1
        change = np.ones_like(x)
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            change = change * (c * d)
        h = h * change
    return h


def beta_cdf(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); 0 and 1 outside (0, 1)."""
    x = np.asarray(x, float)
    out = np.where(x >= 1, 1.0, 0.0)
    inner = (x > 0) & (x < 1)
    front = lambda z: np.exp(a * np.log(z) + b * np.log1p(-z) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
    low = inner & (x < (a + 1) / (a + b + 2))
    if low.any():
        out[low] = front(x[low]) * _beta_fraction(a, b, x[low]) / a
    high = inner & ~low
    if high.any():
        out[high] = 1 - front(x[high]) * _beta_fraction(b, a, 1 - x[high]) / b
    return np.clip(out, 0.0, 1.0)


def cdf(name: str, params: dict, x) -> np.ndarray:
    """CDF of a fitted family at the values ``x``."""
    z = (np.asarray(x, float) - params["loc"]) / params["scale"]
    if name == "norm":
        return norm_cdf(z)
    if name == "expon":
        return np.where(z > 0, -np.expm1(-np.maximum(z, 0)), 0.0)
    if name == "uniform":
        return np.clip(z, 0.0, 1.0)
    if name == "lognorm":
        return np.where(z > 0, norm_cdf(np.log(np.where(z > 0, z, 1.0)) / params["s"]), 0.0)
    if name == "gamma":
        return gamma_cdf(params["a"], z)
    if name == "beta":
        return beta_cdf(params["a"], params["b"], z)
    raise ValueError(name)


#: Up to this many rows the p-value is exact, beyond it asymptotic (fixed value that must equal the reference's default).
EXACT_ROWS = 10_000


def _exact_below(n: int, d: float) -> float:
    """P(D_n < d) of the two-sided statistic: the n-th power of a banded matrix of 2k - 1 states, k = ceil(n d), by
    squaring, with the exponent kept apart."""
    k = math.ceil(n * d)
    h = k - n * d
    m = 2 * k - 1
    i = np.arange(m)
    gap = i[:, None] - i[None, :] + 1
    mat = (gap >= 0).astype(float)
    power = h ** np.arange(1, m + 1)
    mat[:, 0] -= power
    mat[-1, :] -= power[::-1]
    mat[-1, 0] += max(0.0, 2 * h - 1) ** m
    # divided by factorials; those beyond the range of doubles make entries that are zero anyway
    fact = np.array([math.exp(-math.lgamma(g + 1)) for g in range(m + 1)])
    mat *= np.where(gap > 0, fact[np.maximum(gap, 0)], 1.0)
    out, shift, base, base_shift, e = np.eye(m), 0, mat, 0, n
    while e:
        if e & 1:
            out, shift = out @ base, shift + base_shift
            big = out[k - 1, k - 1]
            if big > 1e140 or 0 < big < 1e-140:
                step = int(math.floor(math.log10(big)))
                out, shift = out * 10.0 ** -step, shift + step
        base, base_shift = base @ base, 2 * base_shift
        big = base[k - 1, k - 1]
        if big > 1e140 or 0 < big < 1e-140:
            step = int(math.floor(math.log10(big)))
            base, base_shift = base * 10.0 ** -step, base_shift + step
        e >>= 1
    value = out[k - 1, k - 1]
    if value <= 0:
        return 0.0
    return math.exp(math.log(value) + shift * math.log(10) + math.lgamma(n + 1) - n * math.log(n))


def ks_pvalue(n: int, d: float) -> float:
    """Two-sided p-value of the Kolmogorov-Smirnov statistic ``d`` of ``n`` rows: exact up to EXACT_ROWS rows, but for
    tails below 1e-9, which are given by their upper bound 2 exp(-2 n d^2)."""
    if d <= 0 or n <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if 2 * math.exp(-2 * n * d * d) < 1e-9:
        return 2 * math.exp(-2 * n * d * d)
    if n <= EXACT_ROWS:
        return min(1.0, max(0.0, 1.0 - _exact_below(n, d)))
    x = math.sqrt(n) * d
    if x < 0.2:  # the other series of the same function, which converges for small x
        return 1.0 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * j - 1) * math.pi) ** 2 / (8 * x * x)) for j in range(1, 20))
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))
