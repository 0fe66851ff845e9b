"""Plain robust straight lines, one series each, to compare the operators with."""

from __future__ import annotations

import math

import numpy as np

from glacierlens.functions.regression import t_quantile_975, t_two_sided

# fixed values: tuning constants, iteration limits
BISQUARE_TUNE = 4.685
HUBER_TUNE = 1.345
MAD_NORMAL = 0.6744897501960817
MAX_ITER = 50


def _wls(x, y, w):
    sw = w.sum()
    mx, my = (w * x).sum() / sw, (w * y).sum() / sw
    sxx = (w * (x - mx) ** 2).sum()
    b = (w * (x - mx) * (y - my)).sum() / sxx
    return my - b * mx, b


def _bisquare(u):
    return np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0.0)


def bisquare_line(x, y):
    """(slope, intercept, p, half 95 % interval), leverage-adjusted (Holland & Welsch 1977).

    The scale is the median absolute residual without the p smallest ones; the
    covariance uses the pseudo-values of Street, Carroll & Ruppert (1988).
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, p = len(x), 2
    sxx = ((x - x.mean()) ** 2).sum()
    if n < 3 or sxx == 0:
        return None
    h = np.minimum(1 / n + (x - x.mean()) ** 2 / sxx, 0.9999)
    adj = 1 / np.sqrt(1 - h)
    a, b = _wls(x, y, np.ones(n))
    ols = math.sqrt(((y - a - b * x) ** 2).sum() / (n - p))
    tiny = 1e-6 * y.std(ddof=1) or 1.0

    def spread(r):
        return np.median(np.sort(np.abs(r))[p - 1 :]) / 0.6745

    for _ in range(MAX_ITER):
        r = (y - a - b * x) * adj
        s = max(spread(r), tiny)
        w = _bisquare(r / (s * BISQUARE_TUNE))
        if (w > 0).sum() < p:
            break
        a1, b1 = _wls(x, y, w)
        done = max(abs(a1 - a) / max(abs(a1), abs(a), 1e-300), abs(b1 - b) / max(abs(b1), abs(b), 1e-300)) <= 1.5e-8
        a, b = a1, b1
        if done:
            break
    r = (y - a - b * x) * adj
    s = max(spread(r), tiny)
    st, d = s * BISQUARE_TUNE, 1e-4
    u = r / st
    phi = u * _bisquare(u)
    up = (u + d) * _bisquare(u + d)
    dn = (u - d) * _bisquare(u - d)
    m1 = ((up - dn) / (2 * d)).mean()
    m2 = ((1 - h) * phi**2).sum() / (n - p)
    robust = (1 + p / n * (1 - m1) / m1) * math.sqrt(m2) * st / m1 if m1 > 0 else ols
    sigma = max(robust, math.sqrt((ols**2 * p**2 + robust**2 * n) / (p**2 + n)))
    se = sigma / math.sqrt(sxx)
    pv = float(t_two_sided(np.array([b / se]), np.array([n - p]))[0]) if se > 0 else 0.0
    return b, a, pv, t_quantile_975(n - p) * se


def huber_line(x, y):
    """(slope, intercept, p, half 95 % interval) with Huber weights (1981), normal inference."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, p = len(x), 2
    sxx = ((x - x.mean()) ** 2).sum()
    if n < 3 or sxx == 0:
        return None
    a, b = _wls(x, y, np.ones(n))
    s = np.median(np.abs(y - a - b * x)) / MAD_NORMAL
    last = None
    for _ in range(MAX_ITER):
        if s <= 0:
            break
        u = np.abs(y - a - b * x) / s
        a, b = _wls(x, y, np.where(u <= HUBER_TUNE, 1.0, HUBER_TUNE / np.maximum(u, 1e-300)))
        r = y - a - b * x
        s = np.median(np.abs(r)) / MAD_NORMAL
        if s <= 0:
            break
        z = np.abs(r / s)
        dev = np.where(z <= HUBER_TUNE, z * z / 2, HUBER_TUNE * z - HUBER_TUNE**2 / 2).sum()
        if last is not None and abs(dev - last) <= 1e-8:
            break
        last = dev
    if s <= 0:
        return b, a, 0.0, 0.0
    z = (y - a - b * x) / s
    inner = np.abs(z) <= HUBER_TUNE
    m = inner.mean()
    k = 1 + p / n * inner.var() / m**2
    psi = np.clip(z, -HUBER_TUNE, HUBER_TUNE)
    var = k**2 * (psi**2).sum() * s * s / (n - p) / m**2 / sxx
    se = math.sqrt(var)
    pv = math.erfc(abs(b) / se / math.sqrt(2)) if se > 0 else 0.0
    return b, a, pv, 1.959963984540054 * se
