"""Least squares from moments, p-values and robust line fits."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.session import settle


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 + even * d
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + even / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + odd * d
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + odd / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function, elementwise."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = x > (a + 1.0) / (a + b + 2.0)
    left = front * _beta_fraction(a, b, inner) / a
    right = 1.0 - front * _beta_fraction(b, a, 1.0 - inner) / b
    out = np.where(swap, right, left)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df):
    """Two-sided p-value of Student's t, elementwise numpy."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))


@functools.lru_cache(maxsize=None)
def t_quantile_975(df: float) -> float:
    """97.5 % point of Student's t: the p-value on a grid, refined three times."""
    lo, hi = 1.0, 20.0
    if df < 3:
        hi = 20.0 if df == 2 else 100.0
    for _ in range(6):
        grid = np.linspace(lo, hi, 400)
        p = t_two_sided(grid, np.full(400, float(df)))
        i = int(np.searchsorted(-p, -0.05))
        lo, hi = grid[max(i - 1, 0)], grid[min(i, 399)]
    return float((lo + hi) / 2)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index, dtype=float)
    if ok.any():
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def t_quantile(df: pd.Series) -> pd.Series:
    """97.5 % point of Student's t with so many degrees of freedom."""
    return df.map(lambda nu: t_quantile_975(float(nu)) if nu > 0 else None).astype(float)


# fixed value: 97.5 % point of the normal distribution
NORMAL_975 = 1.959963984540054


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided p-value of the normal distribution."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL where a side doesn't vary (``corr`` divides by 0 there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Ordinary least squares of y on x per key: slope, intercept, r, p, stderr.

    One aggregation of moments; the p-value runs on one row per key.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.where(both).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_sxx(yc, xc).alias("_sxx"),
        F.regr_syy(yc, xc).alias("_syy"),
        F.regr_sxy(yc, xc).alias("_sxy"),
    )
    usable = (F.col("n") > 2) & (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    r = F.when((F.col("_sxx") > 0) & (F.col("_syy") > 0), F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy")))
    m = m.withColumn("r", r)
    rest = F.greatest(F.lit(1.0) - F.col("r") * F.col("r"), F.lit(0.0))
    t = F.when(usable & (rest > 0), F.col("r") * F.sqrt((F.col("n") - 2) / rest))
    err = F.when(usable, F.sqrt(rest * F.col("_syy") / F.col("_sxx") / (F.col("n") - 2)))
    return m.select(
        *keys, "n", "slope", "intercept", "r",
        F.when(usable & (rest <= 0), F.lit(0.0))
        .otherwise(t_pvalue(t.cast("double"), (F.col("n") - 2).cast("double"))).alias("p"),
        err.alias("stderr"),
    )


def solve3(a: Sequence[Sequence[Column]], b: Sequence[Column]) -> list[Column]:
    """Cramer's rule for 2x2 to 4x4 systems of columns."""

    def det(m):
        if len(m) == 1:
            return m[0][0]
        total = None
        for j, top in enumerate(m[0]):
            minor = [row[:j] + row[j + 1 :] for row in m[1:]]
            term = top * det(minor)
            if j % 2:
                term = -term
            total = term if total is None else total + term
        return total

    rows = [list(r) for r in a]
    base = det(rows)
    out = []
    for k in range(len(b)):
        swapped = [r[:k] + [b[i]] + r[k + 1 :] for i, r in enumerate(rows)]
        out.append(F.when(base != 0, det(swapped) / base))
    return out


def poly_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """Least-squares polynomial (degree 1-3) per key, coefficients c0..c3.

    The mean and the range of x per key come first, and powers are summed of
    the centred and scaled x, so no digits cancel.  The centre is returned as
    ``x0`` so that y = sum c_k (x - x0)^k.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.lit(0).alias("_all"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    wanted, keys = list(keys), list(keys) or ["_all"]
    range_ = (F.max("_x") - F.min("_x")) / 2
    centre = rows.groupBy(*keys).agg(F.avg("_x").alias("x0"), F.when(range_ > 0, range_).otherwise(1.0).alias("_scale"))
    named = settle(centre.toDF(*[f"_k{i}" for i in range(len(keys))], "x0", "_scale"))
    rows = rows.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    d = (F.col("_x") - F.col("x0")) / F.col("_scale")
    sums = [F.sum(F.pow(d, F.lit(k))).alias(f"_u{k}") for k in range(2 * degree + 1)]
    sums += [F.sum(F.pow(d, F.lit(k)) * F.col("_y")).alias(f"_w{k}") for k in range(degree + 1)]
    s = rows.groupBy(*keys, "x0", "_scale").agg(F.count("*").alias("n"), *sums)
    a = [[F.col(f"_u{i + j}") for j in range(degree + 1)] for i in range(degree + 1)]
    coef = solve3(a, [F.col(f"_w{i}") for i in range(degree + 1)])
    return s.select(*wanted, "n", "x0", *[(c / F.pow("_scale", F.lit(i))).alias(f"c{i}") for i, c in enumerate(coef)])


def poly_value(degree: int, x: Column) -> Column:
    """Value at x of a polynomial with columns x0, c0..c_degree."""
    d = x - F.col("x0")
    total = F.col("c0")
    for k in range(1, degree + 1):
        total = total + F.col(f"c{k}") * F.pow(d, F.lit(k))
    return total


def poly_grid(coef: DataFrame, keys: Sequence[str], degree: int, x_max: Column, step: float = 0.5) -> DataFrame:
    """Evaluate the fits on 0, step, ... below x_max."""
    last = F.ceil(x_max / step).cast("long") - 1
    xs = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0).cast("long"))))
    return coef.withColumn("_i", xs).withColumn("x", F.col("_i") * step).select(
        *keys, "x", poly_value(degree, F.col("x")).alias("y")
    )
