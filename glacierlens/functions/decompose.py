"""Seasonal-trend decomposition by LOESS (Cleveland et al. 1990) of one series."""

from __future__ import annotations

import numpy as np


def loess(y: np.ndarray, q: int, at: np.ndarray, rw: np.ndarray | None = None) -> np.ndarray:
    """Local linear fit of y(1..n) at the positions ``at`` with span q, tricube weights."""
    n = len(y)
    span = min(q, n)
    half = (q + 1) // 2
    left = np.clip(np.floor(at).astype(int) - half + 1, 1, n - span + 1) if q < n else np.ones(len(at), dtype=int)
    right = left + span - 1
    h = np.maximum(at - left, right - at)
    if q > n:
        h = h + (q - n) // 2
    idx = left[:, None] + np.arange(span)[None, :]
    r = np.abs(idx - at[:, None])
    h = np.maximum(h, 1e-12)[:, None]
    w = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1.0 - (r / h) ** 3) ** 3, 0.0))
    vals = y[idx - 1]
    if rw is not None:
        w = w * rw[idx - 1]
    total = w.sum(axis=1)
    safe = np.where(total > 0, total, 1.0)
    w = w / safe[:, None]
    a = (w * idx).sum(axis=1)
    c = (w * (idx - a[:, None]) ** 2).sum(axis=1)
    linear = np.sqrt(c) > 0.001 * (n - 1)
    slope = np.where(linear, (at - a) / np.where(c > 0, c, 1.0), 0.0)
    w = w * (1.0 + slope[:, None] * (idx - a[:, None]))
    fit = (w * vals).sum(axis=1)
    nearest = y[np.clip(np.rint(at).astype(int), 1, n) - 1]
    return np.where(total > 0, fit, nearest)


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int, seasonal: int, trend: int, robust: bool = False):
    """(trend, seasonal, robustness weights) of an evenly spaced series."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if n < 2 * period:
        raise ValueError("the series needs two full periods")
    low = period + 1 if period % 2 == 0 else period + 2
    inner, outer = (2, 15) if robust else (5, 0)
    at = np.arange(1, n + 1, dtype=float)
    tr, se, rw = np.zeros(n), np.zeros(n), None
    for it in range(outer + 1):
        for _ in range(inner):
            d = y - tr
            cyc = np.empty(n + 2 * period)
            for s in range(period):
                sub = d[s::period]
                k = len(sub)
                sub_rw = None if rw is None else rw[s::period]
                cyc[s::period][: k + 2] = loess(sub, seasonal, np.arange(0, k + 2, dtype=float), sub_rw)
            smooth = _moving(_moving(_moving(cyc, period), period), 3)
            lowpass = loess(smooth, low, at)
            se = cyc[period : period + n] - lowpass
            tr = loess(y - se, trend, at, rw)
        if it < outer:
            r = np.abs(y - tr - se)
            six = 6.0 * np.median(r)
            if six <= 0:
                break
            u = r / six
            rw = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1.0 - u * u) ** 2, 0.0))
    return tr, se, (np.ones(n) if rw is None else rw)
