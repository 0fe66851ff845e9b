"""Robust trends and seasonal-trend decomposition, one short series per group.

Each group is a series with one row per window or month, so it fits a task
whatever the number of rows behind it; the rows were aggregated before.  Robust lines
are folds over arrays of points, see ``functions.robust_lines``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glacierlens.functions import robust_lines as rl
from glacierlens.functions.decompose import stl
from glacierlens.functions.regression import NORMAL_975, normal_pvalue, t_pvalue, t_quantile
from glacierlens.operators.series import hampel


def _series(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """One row per key: ``n``, the points in order, the sum of squares of x, the plain line's spread, a floor for scales."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_p")
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("n"), points, F.stddev_samp("y").alias("_sd"))
    mean = rl.total(F.col("_p"), lambda p: p["x"]) / F.col("n")
    sxx = rl.let(mean, lambda m: rl.total(F.col("_p"), lambda p: (p["x"] - m) * (p["x"] - m)))
    return grouped.withColumns({"_sxx": sxx, "_tiny": F.when(F.col("_sd") > 0, 1e-6 * F.col("_sd")).otherwise(F.lit(1.0))})


def _usable(min_points: int):
    return (F.col("n") >= F.lit(max(min_points, 3))) & (F.col("_sxx") > 0)


def robust_trend_bisquare(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 10) -> DataFrame:
    """Bisquare line of y on x (days): slope, intercept, p, half 95 % interval."""
    rows = _series(df, keys, x, y).withColumn("_p", F.when(_usable(min_points), rl.with_leverage(F.col("_p"))))
    points, tiny = F.col("_p"), F.col("_tiny")
    plain = rl.weighted_line(points, lambda p: F.lit(1.0))
    squares = rl.let(plain, lambda l: rl.total(points, lambda p: (p["y"] - l["a"] - l["b"] * p["x"]) * (p["y"] - l["a"] - l["b"] * p["x"])))
    rows = rows.withColumn("_line", F.when(points.isNotNull(), rl.bisquare_line(points, tiny)))
    rows = rows.withColumn("_ols", F.when(points.isNotNull(), F.sqrt(squares / (F.col("n") - 2))))
    sigma = rl.bisquare_sigma(points, F.col("_line"), tiny, F.col("_ols"))
    rows = rows.withColumn("_se", F.when(points.isNotNull(), sigma / F.sqrt("_sxx")))
    slope, se, nu = F.col("_line.b"), F.col("_se"), (F.col("n") - 2).cast("double")
    return rows.select(
        *keys, "n", slope.alias("slope"), F.col("_line.a").alias("intercept"),
        F.when(se > 0, t_pvalue(F.try_divide(slope, se), nu)).when(se == 0, F.lit(0.0)).alias("p"), (t_quantile(nu) * se).alias("half_ci"),
    )


def robust_trend_huber(df: DataFrame, keys: Sequence[str], x: str, y: str, n: str | None = "n",
                       min_count: int = 20, min_points: int = 10) -> DataFrame:
    """Values with n >= min_count and not 0, Hampel-filtered in order of x, then a Huber line with normal inference."""
    ok = F.col(y).isNotNull()
    if n is not None:
        ok = ok & (F.col(n) >= min_count) & (F.col(y) != 0)
    clean = hampel(df.where(ok), keys, x, y).withColumn(y, F.col("filtered")).drop("filtered", "is_outlier")
    rows = _series(clean, keys, x, y).withColumn("_p", F.when(_usable(min_points), F.col("_p")))
    points = F.col("_p")
    rows = rows.withColumn("_line", F.when(points.isNotNull(), rl.huber_line(points)))
    rows = rows.withColumn("_se", F.when(points.isNotNull(), rl.huber_error(points, F.col("_line"), F.col("_sxx"))))
    slope, se = F.col("_line.b"), F.col("_se")
    return rows.select(
        *keys, "n", slope.alias("slope"), F.col("_line.a").alias("intercept"),
        F.when(se > 0, normal_pvalue(F.try_divide(slope, se))).when(se == 0, F.lit(0.0)).alias("p"), (NORMAL_975 * se).alias("half_ci"),
    )


def seasonal_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], period: int = 12,
                   trend: int = 241, seasonal: int = 13, robust: bool = False) -> DataFrame:
    """Adds value_trend, value_seasonal and value_resid per series.

    ``order`` is one column of whole steps, or a cycle and the step within it.
    Series that are shorter than two periods, lack a step or value, or have one
    twice get NULL.
    """
    keys, order, values = list(keys), list(order), list(values)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    extra = ", ".join(f"{v}_trend double, {v}_seasonal double, {v}_resid double" for v in values)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        step = pdf[order[-1]].to_numpy(float) + (period * pdf[order[0]].to_numpy(float) if len(order) > 1 else 0.0)
        even = len(step) >= 2 * period and (np.diff(step) == 1).all()
        for v in values:
            y = pdf[v].to_numpy(float)
            ok = even and np.isfinite(y).all()
            tr, se, _ = stl(y, period, seasonal, trend, robust) if ok else (np.full(len(y), np.nan),) * 3
            pdf[f"{v}_trend"], pdf[f"{v}_seasonal"], pdf[f"{v}_resid"] = tr, se, y - tr - se
        return pdf

    return df.groupBy(*keys).applyInPandas(run, f"{fields}, {extra}")
