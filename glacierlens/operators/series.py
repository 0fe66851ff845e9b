"""Windows over one short series per key: filters, gaps, smoothing, buckets.

A series holds one row per time step of a calendar, so a window over it is
bounded by the length of the record, whatever the number of series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.quantiles import group_quantiles
from glacierlens.functions.scalars import clip

# fixed value: scale of the median absolute deviation
MAD_SCALE = 1.4826


def hampel(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int = 5, n: float = 3.0) -> DataFrame:
    """Replace outliers by the rolling median over +-k rows (shrinking at the ends)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)
    near = df.withColumn("_w", F.collect_list(value).over(w))
    near = near.withColumn("_med", array_median(F.col("_w")))
    dev = F.transform("_w", lambda x: F.abs(x - F.col("_med")))
    near = near.withColumn("_mad", array_median(dev))
    out = F.abs(F.col(value) - F.col("_med")) > n * MAD_SCALE * F.col("_mad")
    return near.withColumn("is_outlier", out).withColumn(
        "filtered", F.when(out, F.col("_med")).otherwise(F.col(value))
    ).drop("_w", "_med", "_mad")


def array_median(arr: Column) -> Column:
    """Median of a short array; NULL for an empty one."""
    a = F.array_sort(arr)
    m = F.size(arr)
    lo, hi = F.floor((m + 1) / 2).cast("int"), F.floor((m + 2) / 2).cast("int")
    return F.when(m > 0, (F.element_at(a, lo) + F.element_at(a, hi)) / 2)


def winter_difference(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Median of [Nov 1, Apr 1) per winter, minus the winter before; NULL after a gap."""
    m, y = F.month(date), F.year(date)
    winter = F.when(m >= 11, y).otherwise(y - 1).cast("int")
    cold = df.where(m.isin(11, 12, 1, 2, 3)).withColumn("winter", winter)
    med = group_quantiles(cold, [*keys, "winter"], value, {"med": 0.5}).drop("n")
    return _step(med, keys, "winter", "med")


def annual_difference(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """value(y) - value(y-1), NULL if a year is missing."""
    return _step(df, keys, "yr", value)


def _step(df, keys, order, value):
    w = Window.partitionBy(*keys).orderBy(order)
    adjacent = F.col(order) - F.lag(order).over(w) == 1
    return df.withColumn("difference", F.when(adjacent, F.col(value) - F.lag(value).over(w)))


def mu_candidates(df: DataFrame, half: int = 15, prcp: str = "prcp", temp: str = "temp") -> DataFrame:
    """(2*half+1)-year mean prcp / mean temp; NULL at the ends or if too cold."""
    w = Window.partitionBy("glacier_id").orderBy("yr").rowsBetween(-half, half)
    full = F.count("*").over(w) == 2 * half + 1
    t = F.avg(temp).over(w)
    return df.withColumn("mu", F.when(full & (t > 1e-3), F.avg(prcp).over(w) / t))


def best_reference_year(candidates: DataFrame, climate: DataFrame, observed: DataFrame) -> DataFrame:
    """Candidate year whose mu gives the smallest absolute bias over the observed years.

    mean(prcp - mu*temp) is linear in mu, so two means per glacier suffice.
    """
    ref = observed.join(climate, ["glacier_id", "yr"]).groupBy("glacier_id").agg(
        F.avg("prcp").alias("_p"), F.avg("temp").alias("_t"), F.avg("mb").alias("_mb")
    )
    bias = F.col("_p") - F.col("mu") * F.col("_t") - F.col("_mb")
    rows = candidates.where(F.col("mu").isNotNull()).select("glacier_id", "yr", "mu").join(ref, "glacier_id").withColumn("bias", bias)
    best = rows.groupBy("glacier_id").agg(F.min(F.struct(F.abs("bias").alias("d"), "yr", "mu", "bias")).alias("_b"))
    return best.select("glacier_id", F.col("_b.yr").alias("t_star"), F.col("_b.mu").alias("mu"), F.col("_b.bias").alias("bias"))


def kernel_weights(window: int, kernel: str) -> list[float]:
    if window % 2 == 0:
        raise ValueError("the window should be odd")
    h = window // 2
    if kernel == "gaussian":
        raw = [math.exp(-0.5 * o * o) for o in range(-h, h + 1)]
    elif kernel == "mean":
        raw = [1.0] * window
    else:
        raise ValueError(f"unknown kernel {kernel!r}")
    total = sum(raw)
    return [x / total for x in raw]


def smooth1d(df: DataFrame, keys: Sequence[str], order: str, value: str, window: int | None = None,
             kernel: str = "gaussian") -> DataFrame:
    """Centred smoothing with mirrored ends.

    Without a window the widest of 9, 7, 5, 3 that the series allows is used.
    Each row adds its weighted value to its neighbours' sums, also through the
    mirrors at both ends.
    """
    per = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(per.orderBy(order)) - 1).withColumn("_n", F.count("*").over(per))
    if window:
        tables = {window: None}
        size = F.lit(window)
    else:
        tables = {9: None, 7: None, 5: None, 3: None}
        size = F.when(F.col("_n") >= 9, 9).when(F.col("_n") >= 7, 7).when(F.col("_n") >= 5, 5).otherwise(3)
    weights = F.create_map(*[
        x for w in tables for x in (F.lit(w), F.array(*[F.lit(v) for v in kernel_weights(w, kernel)]))
    ])
    near = rows.withColumn("_w", F.element_at(weights, size)).withColumn("_h", F.floor(F.size("_w") / 2).cast("int"))
    near = near.withColumn("_s", F.collect_list(F.col(value)).over(per.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # mirror index: period 2(n-1), reflected without repeating the end value
    period = F.greatest(2 * (F.col("_n") - 1), F.lit(1))

    def mirrored(j):
        p = F.pmod(j, period)
        return F.when(p >= F.col("_n"), period - p).otherwise(p).cast("int")

    terms = F.transform(
        "_w", lambda w, o: w * F.get(F.col("_s"), mirrored(F.col("_i") + o - F.col("_h")))
    )
    smooth = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return near.withColumn("smooth", smooth).drop("_i", "_n", "_w", "_h", "_s")


def interp_nulls(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Linear in the row index between known values; the ends take the nearest one."""
    per = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(per))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).alias("v")))
    past = F.last(known, ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(per.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_a", past).withColumn("_b", ahead)
    share = (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(
        F.col("_b").isNull(), F.col("_a.v")
    ).otherwise(line)
    return rows.withColumn("filled", filled).drop("_i", "_a", "_b")


def sign_change(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """1 where the sign flips; a zero takes the sign before it (cyclically).

    The first row compares with the last, unless it has the sign of the second.
    """
    per = Window.partitionBy(*keys).orderBy(order)
    whole = per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sign = F.when(F.col(value) != 0, F.signum(value))
    rows = df.withColumn("_raw", sign)
    held = F.coalesce(F.last("_raw", ignorenulls=True).over(per), F.last("_raw", ignorenulls=True).over(whole))
    rows = rows.withColumn("_s", held)
    before = F.lag("_s").over(per)
    first = F.row_number().over(per) == 1
    cyclic = F.when(first, F.last("_s").over(whole)).otherwise(before)
    flips = (cyclic != F.col("_s")).cast("int")
    out = F.when(first & (F.lead("_s").over(per) == F.col("_s")), 0).otherwise(flips)
    return rows.withColumn("change", out).drop("_raw", "_s")


def snow_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], snow: str, melt: str) -> DataFrame:
    """b = max(b + snow - melt, 0), with melt limited to the bucket.

    Closed form: with C the running sum of snow - melt, b = C - min(0, min C so far).
    After a missing month the bucket is unknown, and NULL from there on.
    """
    per = Window.partitionBy(*keys).orderBy(*order)
    so_far = per.rowsBetween(Window.unboundedPreceding, 0)
    step = F.col(snow) - F.col(melt)
    known = F.count(F.when(step.isNull(), 1)).over(so_far) == 0
    c = df.withColumn("_c", F.when(known, F.sum(step).over(so_far)))
    c = c.withColumn("bucket", F.col("_c") - clip(F.min("_c").over(so_far), hi=0.0))
    there = F.when(F.row_number().over(per) == 1, F.lit(0.0)).otherwise(F.lag("bucket").over(per)) + F.col(snow)
    return c.withColumn("melt_limited", F.when(there < F.col(melt), there).when(there >= F.col(melt), F.col(melt))).drop("_c")
