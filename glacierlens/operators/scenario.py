"""Bias correction of climate ensembles and scenario series.

Series are glacier_id (+ member keys), yr, mo, temp, prcp.  Groups are a
member's months or one calendar month of a member, so arrays and windows hold
one value per year of the record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.scalars import clip
from glacierlens.operators.climate import FUTURE_PRCP_WEIGHTS, TEMP_WEIGHTS, step_score


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def delta_method(model: DataFrame, ref: DataFrame, y0: int, y1: int, members: Sequence[str] = ("gcm", "ssp"),
                 scale_std: bool = True) -> DataFrame:
    """Monthly anomaly correction of a model to the reference years y0..y1.

    temp: minus the model's, plus the reference's monthly mean; prcp: ratio of
    the means, additive where the model mean is 0, never negative.  With
    ``scale_std`` the deviation from a centred same-month mean of N+1 years is
    first scaled by the ratio of the standard deviations (N years, even).
    """
    n = y1 - y0 + 1
    if scale_std and n % 2:
        raise ValueError("the reference period needs an even number of years")
    month = ["glacier_id", *members, "mo"]
    span = F.col("yr").between(y0, y1)
    per = Window.partitionBy(*month)
    r = ref.where(span).groupBy("glacier_id", "mo").agg(
        F.avg("temp").alias("_rt"), F.avg("prcp").alias("_rp"), F.stddev_pop("temp").alias("_rs")
    )
    m = model.join(r, ["glacier_id", "mo"])
    if scale_std:
        near = per.orderBy("yr").rowsBetween(-(n // 2), n // 2)
        m = m.withColumn("_f", F.try_divide(F.col("_rs"), F.stddev_pop(F.when(span, F.col("temp"))).over(per)))
        m = m.withColumn("_m", F.avg("temp").over(near))
        m = m.withColumn("temp", F.col("_m") + (F.col("temp") - F.col("_m")) * F.col("_f"))
    mt = F.avg(F.when(span, F.col("temp"))).over(per)
    mp = F.avg(F.when(span, F.col("prcp"))).over(per)
    ratio = F.when(mp != 0, F.col("prcp") / mp * F.col("_rp")).otherwise(F.col("prcp") - mp + F.col("_rp"))
    return m.select(
        "glacier_id", *members, "yr", "mo",
        (F.col("temp") - mt + F.col("_rt")).alias("temp"),
        clip(ratio, lo=0.0).alias("prcp"),
    )


def splice(hist: DataFrame, ref: DataFrame, keys: Sequence[str] = ("glacier_id",)) -> DataFrame:
    """Reference values replace the history from the first reference month on."""
    t = F.col("yr") * 12 + F.col("mo")
    start = ref.groupBy(*keys).agg(F.min(t).alias("_t0"))
    before = hist.join(start, list(keys), "left").where(F.col("_t0").isNull() | (t < F.col("_t0")))
    return before.select(*hist.columns).unionByName(ref.select(*hist.columns))


def replace_history(model: DataFrame, obs: DataFrame, start: int) -> DataFrame:
    """Model series with the observed values before the year ``start`` where there are any."""
    o = obs.where(F.col("yr") < start).select(
        "glacier_id", "yr", "mo", F.col("temp").alias("_ot"), F.col("prcp").alias("_op")
    )
    j = model.join(o, ["glacier_id", "yr", "mo"], "left")
    return j.withColumn("temp", F.coalesce("_ot", "temp")).withColumn("prcp", F.coalesce("_op", "prcp")).drop("_ot", "_op")


def sorted_quantile(arr: Column, tau: Column) -> Column:
    """Linear quantile of a sorted array at (n-1)*tau."""
    pos = (F.size(arr) - 1) * tau
    lo = F.floor(pos).cast("int")
    a, b = F.get(arr, lo), F.coalesce(F.get(arr, lo + 1), F.get(arr, lo))
    return a + (b - a) * (pos - lo)


def percent_rank_avg(keys: Sequence[str], value: str, kind: str = "average") -> Column:
    """Rank share in (0, 1]: average rank of ties over n, or count(<=) over n; NULL has none."""
    per = Window.partitionBy(*keys)
    ordered = per.orderBy(F.asc_nulls_last(value))
    n = F.count(value).over(per)
    ties = F.count(value).over(ordered.rangeBetween(0, 0))
    up_to = F.rank().over(ordered) + ties - 1
    share = up_to / n if kind == "count" else (F.rank().over(ordered) + (ties - 1) / 2) / n
    return F.when(F.col(value).isNotNull(), share)


def qdm(obs: DataFrame, hist: DataFrame, fut: DataFrame, members: Sequence[str] = ("gcm", "ssp"),
        tau: str = "average", max_ratio: float = 4.0) -> DataFrame:
    """Quantile delta mapping per glacier, member and calendar month.

    temp: Q_obs(t) + x - Q_mod(t).  prcp: Q_obs(t) * x / Q_mod(t); a ratio that
    is above ``max_ratio`` or not finite falls back to the ratio of the month's
    medians, then to that of all months.
    """
    series, month = ["glacier_id", *members], ["glacier_id", *members, "mo"]
    o = obs.groupBy("glacier_id", "mo").agg(
        F.array_sort(F.collect_list("temp")).alias("_ot"), F.array_sort(F.collect_list("prcp")).alias("_op")
    )
    h = hist.groupBy(*month).agg(
        F.array_sort(F.collect_list("temp")).alias("_ht"), F.array_sort(F.collect_list("prcp")).alias("_hp")
    )
    half = F.lit(0.5)
    all_hist = hist.groupBy(*series).agg(F.percentile("prcp", half).alias("_hall"))
    all_fut = fut.groupBy(*series).agg(F.percentile("prcp", half).alias("_fall"))
    tables = h.join(o, ["glacier_id", "mo"]).join(all_hist.join(all_fut, series), series)
    f = fut.select(
        *month, "yr", "temp", "prcp",
        percent_rank_avg(month, "temp", tau).alias("_tt"),
        percent_rank_avg(month, "prcp", tau).alias("_tp"),
        F.percentile("prcp", half).over(Window.partitionBy(*month)).alias("_fmed"),
    ).join(tables, month)
    bad = lambda c: ~_finite(c) | (c > max_ratio)
    div = lambda a, b: F.when(b != 0, a / b)
    f = f.withColumn("_r1", div(F.col("prcp"), sorted_quantile(F.col("_hp"), F.col("_tp"))))
    f = f.withColumn("_r2", div(F.col("_fmed"), sorted_quantile(F.col("_hp"), half)))
    r3 = div(F.col("_fall"), F.col("_hall"))
    ratio = F.when(~bad(F.col("_r1")), F.col("_r1")).when(~bad(F.col("_r2")), F.col("_r2")).otherwise(r3)
    return f.select(
        *month, "yr",
        (sorted_quantile(F.col("_ot"), F.col("_tt")) + F.col("temp") - sorted_quantile(F.col("_ht"), F.col("_tt"))).alias("temp"),
        clip(sorted_quantile(F.col("_op"), F.col("_tp")) * ratio, lo=0.0).alias("prcp"),
    )


def detrended_qm(obs: DataFrame, fut: DataFrame, members: Sequence[str] = ("gcm", "ssp")) -> DataFrame:
    """Trend plus the observed residual of the same rank, prcp not negative.

    Both sides carry temp_trend and prcp_trend (see ``trends.seasonal_trend``).
    """
    month = ["glacier_id", *members, "mo"]
    res = lambda c: F.col(c) - F.col(f"{c}_trend")
    o = obs.groupBy("glacier_id", "mo").agg(
        F.array_sort(F.collect_list(res("temp"))).alias("_ot"), F.array_sort(F.collect_list(res("prcp"))).alias("_op")
    )
    f = fut.withColumn("_rt", res("temp")).withColumn("_rp", res("prcp"))
    f = f.withColumn("_tt", percent_rank_avg(month, "_rt")).withColumn("_tp", percent_rank_avg(month, "_rp"))
    j = f.join(o, ["glacier_id", "mo"])
    return j.select(
        *month, "yr",
        (F.col("temp_trend") + sorted_quantile(F.col("_ot"), F.col("_tt"))).alias("temp"),
        clip(F.col("prcp_trend") + sorted_quantile(F.col("_op"), F.col("_tp")), lo=0.0).alias("prcp"),
    )


# ---- scores and ranks of future years

def future_year_scores(fut: DataFrame, members: Sequence[str] = ("gcm", "ssp")) -> DataFrame:
    """Year scores from thresholds over all future months; 4/2/1 for both variables."""
    series = ["glacier_id", *members]
    q = fut.groupBy(*series).agg(
        F.percentile("temp", F.array(*[F.lit(p / 100) for p, _ in TEMP_WEIGHTS])).alias("_qt"),
        F.percentile("prcp", F.array(*[F.lit(p / 100) for p, _ in FUTURE_PRCP_WEIGHTS])).alias("_qp"),
    )
    q = q.select(
        *series,
        *[F.col("_qt")[i].alias(f"_t{p}") for i, (p, _) in enumerate(TEMP_WEIGHTS)],
        *[F.col("_qp")[i].alias(f"_p{p}") for i, (p, _) in enumerate(FUTURE_PRCP_WEIGHTS)],
    )
    j = fut.join(q, series)
    return j.groupBy(*series, "yr").agg(
        F.sum(step_score(F.col("temp"), TEMP_WEIGHTS, True, "_t")).alias("temp_score"),
        F.sum(step_score(F.col("prcp"), FUTURE_PRCP_WEIGHTS, False, "_p")).alias("prcp_score"),
    )


def reverse_rank(scores: DataFrame, keys: Sequence[str], value: str, out: str, split: int | None = None,
                 cap: int | None = None) -> DataFrame:
    """Rank from the highest score, ties to the later year.

    Years before ``split`` rank among themselves, the others over all years.
    """
    order = [F.desc(value), F.desc("yr")]
    all_years = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rank = all_years
    if split is not None:
        early = (F.col("yr") < split).cast("int")
        own = F.row_number().over(Window.partitionBy(*keys, early).orderBy(*order))
        rank = F.when(F.col("yr") < split, own).otherwise(all_years)
    if cap is not None:
        rank = F.least(rank, F.lit(cap))
    return scores.withColumn(out, rank)


def rank_match(future: DataFrame, hist: DataFrame, rank: str, hist_keys: Sequence[str] = ("glacier_id",)) -> DataFrame:
    """Future year of rank r with the historical year of rank ceil(r/2)."""
    h = hist.select(*hist_keys, F.col("yr").alias("hist_yr"), F.col(rank).alias("_hr"))
    f = future.withColumn("_hr", F.ceil(F.col(rank) / 2).cast("int"))
    return f.join(h, [*hist_keys, "_hr"]).drop("_hr")


def _signed_sums(df, keys, var, positive):
    """Sum of within-year anomalies of one sign per year."""
    an = F.col(var) - F.avg(var).over(Window.partitionBy(*keys, "yr"))
    test = F.col("_a") >= 0 if positive else F.col("_a") <= 0
    return df.select(*keys, "yr", an.alias("_a")).groupBy(*keys, "yr").agg(
        F.coalesce(F.sum(F.when(test, F.col("_a"))), F.lit(0.0)).alias("_sum")
    )


def year_scaling(obs: DataFrame, model: DataFrame, matched: DataFrame, var: str, positive: bool,
                 members: Sequence[str] = ("gcm", "ssp"), limit: float = 2.0) -> DataFrame:
    """Scaling per future year: observed over modelled anomaly sum of the matched year."""
    series = ["glacier_id", *members]
    o = _signed_sums(obs, ["glacier_id"], var, positive).select("glacier_id", F.col("yr").alias("hist_yr"), F.col("_sum").alias("_o"))
    m = _signed_sums(model, series, var, positive).select(*series, F.col("yr").alias("hist_yr"), F.col("_sum").alias("_m"))
    j = matched.select(*series, "yr", "hist_yr").join(o, ["glacier_id", "hist_yr"]).join(m, [*series, "hist_yr"])
    # something over nothing is beyond the limit; nothing over nothing is unknown
    k = F.when(F.col("_m") != 0, clip(F.col("_o") / F.col("_m"), hi=limit)).when(F.col("_o") > 0, F.lit(limit))
    return j.select(*series, "yr", k.alias("scaling"))


def rank_scaling(model: DataFrame, temp_scaling: DataFrame, prcp_scaling: DataFrame,
                 members: Sequence[str] = ("gcm", "ssp"), cooling: float | None = None) -> DataFrame:
    """Apply the year scalings to warm and dry anomalies of the future years."""
    series = ["glacier_id", *members]
    j = model.join(temp_scaling.withColumnRenamed("scaling", "_kt"), [*series, "yr"], "left").join(
        prcp_scaling.withColumnRenamed("scaling", "_kp"), [*series, "yr"], "left"
    )
    year = Window.partitionBy(*series, "yr")
    mt, mp = F.avg("temp").over(year), F.avg("prcp").over(year)
    at, ap = F.col("temp") - mt, F.col("prcp") - mp
    temp = F.when(F.col("_kt").isNotNull() & (at >= 0), mt + at * F.col("_kt"))
    if cooling is not None:
        temp = temp.when(F.col("_kt").isNotNull() & (at < 0), mt + at * cooling)
    prcp = F.when(F.col("_kp").isNotNull() & (ap <= 0), mp + ap * F.col("_kp")).otherwise(F.col("prcp"))
    return j.select(*series, "yr", "mo", temp.otherwise(F.col("temp")).alias("temp"), clip(prcp, lo=0.0).alias("prcp"))


def window_scaling(obs: DataFrame, model: DataFrame, y0: int, y1: int, future: int, end: int,
                   members: Sequence[str] = ("gcm", "ssp"), scale: float | None = None) -> DataFrame:
    """Fluctuation ratio obs/model of each reference month, repeated over the future.

    Both sides carry temp_trend and prcp_trend.  Ratios below 0 become 1, above
    2 become 2; with ``scale`` they grow linearly with the future year.
    """
    series = ["glacier_id", *members]
    n = (y1 - y0 + 1) * 12
    ref = F.col("yr").between(y0, y1)
    pos = (F.col("yr") - y0) * 12 + F.col("mo") - 1

    def fluct(c):
        return F.col(c) - F.col(f"{c}_trend")

    o = obs.where(ref).select("glacier_id", pos.alias("_i"), fluct("temp").alias("_ot"), fluct("prcp").alias("_op"))
    m = model.where(ref).select(*series, pos.alias("_i"), fluct("temp").alias("_mt"), fluct("prcp").alias("_mp"))

    def bounded(a, b):
        k = F.when(F.col(b) != 0, F.col(a) / F.col(b))
        return F.when(k < 0, F.lit(1.0)).when(k > 2, F.lit(2.0)).otherwise(k)

    ratios = m.join(o, ["glacier_id", "_i"]).select(*series, "_i", bounded("_ot", "_mt").alias("_kt"), bounded("_op", "_mp").alias("_kp"))
    step = F.when(ref, pos).when(F.col("yr") >= future, F.pmod((F.col("yr") - future) * 12 + F.col("mo") - 1, F.lit(n)))
    j = model.withColumn("_i", step).join(ratios, [*series, "_i"], "left")
    kt, kp = F.col("_kt"), F.col("_kp")
    if scale is not None:
        grow = F.when(F.col("yr") >= future, (F.col("yr") - future) / float(end - future) * scale).otherwise(0.0)
        kt = kt * F.when(fluct("temp") > 0, 1 + grow).otherwise(1 - grow)
        kp = kp * F.when(fluct("prcp") > 0, 1 - grow).otherwise(1 + grow)
    temp = F.when(kt.isNotNull(), F.col("temp_trend") + fluct("temp") * kt).otherwise(F.col("temp"))
    prcp = F.when(kp.isNotNull(), F.col("prcp_trend") + fluct("prcp") * kp).otherwise(F.col("prcp"))
    return j.select(*series, "yr", "mo", temp.alias("temp"), clip(prcp, lo=0.0).alias("prcp"))


# ---- scenario builders

def perturb(df: DataFrame, var: str, year: int, months: Sequence[int], change: float) -> DataFrame:
    hit = (F.col("yr") == year) & F.col("mo").isin(list(months))
    return df.withColumn(var, F.when(hit, F.col(var) + change).otherwise(F.col(var)))


def _with_trend(df: DataFrame, trends: DataFrame) -> DataFrame:
    return df.join(trends.select("glacier_id", "mo", F.col("slope").alias("_k")), ["glacier_id", "mo"], "left")


def trend_years(df: DataFrame, trends: DataFrame, y0: int, y1: int, sign: int) -> DataFrame:
    """temp + sign * trend[month] * (year - y0) in the years y0..y1."""
    j = _with_trend(df, trends)
    add = F.coalesce(F.col("_k"), F.lit(0.0)) * (F.col("yr") - y0) * sign
    return j.withColumn("temp", F.when(F.col("yr").between(y0, y1), F.col("temp") + add).otherwise(F.col("temp"))).select(*df.columns)


def detrend_years(df, trends, y0, y1):
    return trend_years(df, trends, y0, y1, -1)


def add_trend_years(df, trends, y0, y1):
    return trend_years(df, trends, y0, y1, 1)


def swap_decades(df: DataFrame, trends: DataFrame, first: tuple[int, int], second: tuple[int, int], forward: bool = True) -> DataFrame:
    """Copy decade 1 over 2 and add the trend, or 2 over 1 and take it off."""
    src, dst, sign = (first, second, 1) if forward else (second, first, -1)
    shift = dst[0] - src[0]
    copied = df.where(F.col("yr").between(*src)).withColumn("yr", (F.col("yr") + shift).cast("int"))
    copied = trend_years(copied, trends, dst[0], dst[1], sign)
    return df.where(~F.col("yr").between(*dst)).unionByName(copied.select(*df.columns))


def extend_baseline(df: DataFrame, base: tuple[int, int], start: int, end: int, trends: DataFrame | None = None) -> DataFrame:
    """From ``start`` on the monthly mean of the baseline years, optionally warming."""
    mean = df.where(F.col("yr").between(*base)).groupBy("glacier_id", "mo").agg(
        F.avg("temp").alias("temp"), F.avg("prcp").alias("prcp")
    )
    future = mean.withColumn("yr", F.explode(F.sequence(F.lit(start), F.lit(end))))
    if trends is not None:
        future = add_trend_years(future, trends, start, end)
    return df.where(F.col("yr") < start).unionByName(future.select(*df.columns))


def extend_loop(df: DataFrame, loop: tuple[int, int], start: int, end: int, trends: DataFrame | None = None) -> DataFrame:
    """From ``start`` on the loop years again and again, optionally warming."""
    n = loop[1] - loop[0] + 1
    last = F.lit(end)
    first = F.col("yr") - loop[0] + start
    copies = df.where(F.col("yr").between(*loop)).withColumn(
        "yr", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(n))).otherwise(F.array().cast("array<int>")))
    )
    if trends is not None:
        copies = add_trend_years(copies, trends, start, end)
    return df.where(F.col("yr") < start).unionByName(copies.select(*df.columns))


def yearly_amplify(df: DataFrame, factor: float, start: int, members: Sequence[str] = ("gcm", "ssp")) -> DataFrame:
    """Multiply the below-mean temperature anomalies of each future year."""
    mean = F.avg("temp").over(Window.partitionBy("glacier_id", *members, "yr"))
    an = F.col("temp") - mean
    out = F.when((F.col("yr") >= start) & (an < 0), mean + an * factor).otherwise(F.col("temp"))
    return df.withColumn("temp", out)


def combine_hist_future(hist: DataFrame, future: DataFrame, keys: Sequence[str] = ("glacier_id", "gcm", "ssp")) -> DataFrame:
    """Merge months of both parts; the historical one wins."""
    return hist.unionByName(future.join(hist, [*keys, "yr", "mo"], "left_anti"))


def ensemble_mean_member(runs: DataFrame, ref: DataFrame, y0: int, y1: int) -> DataFrame:
    """Annual anomalies, averaged over the Monte-Carlo members, on the monthly reference climate.

    Returns glacier_id, yr, mo, temp, prcp, ready for :func:`delta_method`.
    """
    mean = runs.groupBy("glacier_id", "yr").agg(F.avg("temp").alias("_t"), F.avg("prcp").alias("_p"))
    clim = ref.where(F.col("yr").between(y0, y1)).groupBy("glacier_id", "mo").agg(
        F.avg("temp").alias("_ct"), F.avg("prcp").alias("_cp")
    )
    return mean.join(clim, "glacier_id").select(
        "glacier_id", "yr", "mo", (F.col("_ct") + F.col("_t")).alias("temp"),
        clip(F.col("_cp") + F.col("_p"), lo=0.0).alias("prcp"),
    )
