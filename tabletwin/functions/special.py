"""Scalar special functions for the driver-side solves of the fits (no SciPy in the image)."""

from __future__ import annotations

import math


def lgamma(x: float) -> float:
    return math.lgamma(x)


def digamma(x: float) -> float:
    r = 0.0
    while x < 6.0:
        r -= 1.0 / x
        x += 1.0
    f = 1.0 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    r = 0.0
    while x < 6.0:
        r += 1.0 / (x * x)
        x += 1.0
    f = 1.0 / (x * x)
    return r + 1.0 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def gamma_shape_mle(s: float) -> float:
    """Solve ln(a) - digamma(a) = s (s > 0) by Newton from Minka's starting point."""
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        g = math.log(a) - digamma(a) - s
        dg = 1.0 / a - trigamma(a)
        step = g / dg
        a_new = a - step
        if a_new <= 0:
            a_new = a / 2
        if abs(a_new - a) < 1e-12 * a:
            a = a_new
            break
        a = a_new
    return a


def lbeta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_shapes_mle(lp: float, lq: float) -> tuple[float, float] | None:
    """Solve digamma(a) - digamma(a+b) = lp, digamma(b) - digamma(a+b) = lq by Newton."""
    gm = math.exp(lp) if lp > -700 else 0.0
    gq = math.exp(lq) if lq > -700 else 0.0
    if gm + gq >= 1.0 or gm <= 0 or gq <= 0:
        return None
    a = 0.5 + gm / (2 * (1 - gm - gq))
    b = 0.5 + gq / (2 * (1 - gm - gq))
    for _ in range(100):
        ab = digamma(a + b)
        f1 = digamma(a) - ab - lp
        f2 = digamma(b) - ab - lq
        tab = trigamma(a + b)
        j11, j12, j21, j22 = trigamma(a) - tab, -tab, -tab, trigamma(b) - tab
        det = j11 * j22 - j12 * j21
        if det == 0:
            return None
        da = (f1 * j22 - f2 * j12) / det
        db = (j11 * f2 - j21 * f1) / det
        na, nb = a - da, b - db
        if na <= 0:
            na = a / 2
        if nb <= 0:
            nb = b / 2
        if abs(na - a) < 1e-12 * a and abs(nb - b) < 1e-12 * b:
            return na, nb
        a, b = na, nb
    return a, b


def norm_ppf(p: float) -> float:
    """Inverse standard normal CDF (Acklam's rational approximation refined by one Halley step)."""
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    pl = 0.02425
    if p < pl:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p <= 1 - pl:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)
