"""Run outputs: balances, totals, skill, impact of extreme years, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.regression import correlation
from glacierlens.session import settle, sized_broadcast

# fixed values: ice to water, reported over observed rate of the calibration
ICE_TO_WATER = 0.9
RATE_SHARE = 0.85


def specific_balance(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(V[t+1]-V[t]) / A[t+1] * 0.9 at year t, over A[t] where A[t+1] is 0.

    A series has one row per year, so the window is as long as the run.
    """
    w = Window.partitionBy(*keys).orderBy("yr")
    out = runs.select(
        *keys, "yr", "area", F.lead("volume").over(w).alias("_v1"), F.lead("area").over(w).alias("_a1"), "volume"
    ).where(F.col("_v1").isNotNull())
    dv = F.col("_v1") - F.col("volume")
    smb = F.when(F.col("_a1") != 0, dv / F.col("_a1")).when(
        (dv != 0) & (F.col("area") != 0), dv / F.col("area")
    )
    return out.select(*keys, "yr", "area", (smb * ICE_TO_WATER).alias("smb"))


def cumulative_dh(smb: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running elevation change, the sum of smb / 0.9."""
    w = Window.partitionBy(*keys).orderBy("yr").rowsBetween(Window.unboundedPreceding, 0)
    return smb.withColumn("dh", F.sum(F.col("smb") / ICE_TO_WATER).over(w))


def ensemble_reduce(runs: DataFrame, values: Sequence[str] = ("volume", "area")) -> DataFrame:
    """Sum over glaciers, then mean over models per scenario and year."""
    sums = runs.groupBy("gcm", "ssp", "yr").agg(*[F.sum(c).alias(c) for c in values])
    return sums.groupBy("ssp", "yr").agg(*[F.avg(c).alias(c) for c in values], F.count("*").alias("n_models"))


def region_total_uncertainty(runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Total, sd*sqrt(n) and sd over glaciers per year; n counts all glaciers of the run."""
    n = runs.select(*keys, "rgi_id").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    t = runs.groupBy(*keys, "yr").agg(F.sum(value).alias("total"), F.stddev_pop(value).alias("sd"))
    return t.join(n, list(keys)).withColumn("uncertainty", F.col("sd") * F.sqrt("n"))


def weighted(value: Column, weight: Column) -> Column:
    """Weighted mean as an aggregate, ignoring NULLs and weights of 0 or less."""
    ok = value.isNotNull() & weight.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def weighted_avg(df: DataFrame, keys: Sequence[str], value: str, weight: str, strict: bool = False) -> DataFrame:
    """Weighted mean per key; ``strict`` takes all weights and fails if they sum to 0."""
    if not strict:
        return df.groupBy(*keys).agg(weighted(F.col(value), F.col(weight)).alias("mean"))
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_w"), F.sum(F.col(value) * F.col(weight)).alias("_vw"))
    mean = F.when(F.col("_w") != 0, F.col("_vw") / F.col("_w")).otherwise(
        F.raise_error(F.lit("weights sum to zero")).cast("double")
    )
    return sums.select(*keys, mean.alias("mean"))


def top_years(scores: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n highest years per glacier, ties to the earliest, short series kept whole."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "yr")
    ranked = scores.where(F.col("score").isNotNull()).withColumn("_r", F.row_number().over(w))
    return ranked.where(F.col("_r") <= n).select(key, "yr")


def extreme_impact(
    smb: DataFrame, scores: DataFrame, periods: Sequence[tuple[str, int, int]], key: str = "rgi_id", n: int = 5
) -> DataFrame:
    """Total and extreme-year balance per region and period, weighted by the least area.

    ``smb``: key, region, yr, smb, area.  |smb| > 100 is missing; a glacier
    sum beyond 500 drops out together with its mean.
    """
    label = None
    for name, y0, y1 in periods:
        test = F.col("yr").between(y0, y1)
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    top = top_years(scores, key, n).withColumn("_ext", F.lit(True))
    rows = (
        smb.withColumn("period", label).where(F.col("period").isNotNull())
        .withColumn("_s", F.when(F.abs("smb") <= 100, F.col("smb")))
        .join(top, [key, "yr"], "left")
    )
    ext = F.when(F.col("_ext"), F.col("_s"))
    per = rows.groupBy("region", "period", key).agg(
        F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_sum"),
        F.avg("_s").alias("_mean"),
        F.min("area").alias("_w"),
        F.when(F.count("_ext") > 0, F.coalesce(F.sum(ext), F.lit(0.0))).alias("_esum"),
        F.avg(ext).alias("_emean"),
    )
    calm, ecalm = F.abs("_sum") <= 500, F.abs("_esum") <= 500
    w = F.col("_w")
    out = per.groupBy("region", "period").agg(
        weighted(F.when(calm, F.col("_sum")), w).alias("sum"),
        weighted(F.when(calm, F.col("_mean")), w).alias("avg"),
        weighted(F.when(ecalm, F.col("_esum")), w).alias("ext"),
        weighted(F.when(ecalm, F.col("_emean")), w).alias("avg_ext"),
    )
    return out.withColumn("share", F.when(F.col("sum") != 0, F.col("ext") / F.col("sum")))


def skill(df: DataFrame, keys: Sequence[str] = (), obs: str = "obs", sim: str = "sim") -> DataFrame:
    """NSE, R2, RMSE, percent bias in one pass; NULL where a denominator is 0."""
    o, s = F.col(obs).cast("double"), F.col(sim).cast("double")
    d = s - o
    m = df.where(o.isNotNull() & s.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(d * d).alias("_dd"), F.sum(d).alias("_d"), F.sum(o).alias("_o"),
        F.regr_sxx(s, o).alias("_soo"), F.regr_syy(s, o).alias("_sss"), F.regr_sxy(s, o).alias("_sos"),
    )
    return m.select(
        *keys, "n",
        F.when(F.col("_soo") != 0, 1 - F.col("_dd") / F.col("_soo")).alias("nse"),
        F.when(
            (F.col("_soo") != 0) & (F.col("_sss") != 0),
            F.col("_sos") * F.col("_sos") / (F.col("_soo") * F.col("_sss")),
        ).alias("r2"),
        F.sqrt(F.col("_dd") / F.col("n")).alias("rmse"),
        F.when(F.col("_o") != 0, 100 * F.col("_d") / F.col("_o")).alias("pbias"),
    )


def deviation_metrics(df: DataFrame, keys: Sequence[str] = (), ref: str = "obs", data: str = "sim") -> DataFrame:
    """Mean, absolute and root-mean-square deviation, bias-corrected RMSD, mean relative error, Pearson r."""
    r, x = F.col(ref).cast("double"), F.col(data).cast("double")
    d = x - r
    return df.where(r.isNotNull() & x.isNotNull()).groupBy(*keys).agg(
        F.avg(d).alias("md"),
        F.avg(F.abs(d)).alias("mad"),
        F.sqrt(F.avg(d * d)).alias("rmsd"),
        F.sqrt(F.var_pop(d)).alias("rmsd_bc"),
        F.avg(F.when(r != 0, d / r)).alias("rel_err"),
        correlation(x, r).alias("corr"),
    )


def smb_uncertainty(totals: DataFrame, keys: Sequence[str], limit: float = 100.0) -> DataFrame:
    """sqrt(ev1^2 + ev0^2 + (smb*ea)^2) / area per step, outliers to the series median.

    ``totals``: keys, yr, volume, volume_err, area, area_err, one row per year.
    """
    w = Window.partitionBy(*keys).orderBy("yr")
    nxt = {c: F.lead(c).over(w) for c in ("volume", "volume_err", "area", "area_err")}
    t = totals.select(
        *keys, "yr", "volume", "volume_err", "area", *[c.alias(f"_{k}") for k, c in nxt.items()]
    ).where(F.col("_volume").isNotNull())
    dv = F.col("_volume") - F.col("volume")
    smb = F.when(F.col("_area") != 0, dv / F.col("_area")).when(F.col("area") != 0, dv / F.col("area")) * ICE_TO_WATER
    t = t.withColumn("smb", smb)
    err = F.sqrt(
        F.pow("_volume_err", F.lit(2)) + F.pow("volume_err", F.lit(2)) + F.pow(F.col("smb") * F.col("_area_err"), F.lit(2))
    ) / F.when(F.col("_area") != 0, F.col("_area"))
    t = t.withColumn("_e", err)
    mid = F.percentile("_e", F.lit(0.5)).over(Window.partitionBy(*keys))
    return t.select(
        *keys, "yr", "smb", F.when((F.col("_e") > limit) | F.col("_e").isNull(), mid).otherwise(F.col("_e")).alias("smb_err")
    )


def sensitivity_compare(smb: DataFrame, year: int, scenarios: Sequence[str]) -> DataFrame:
    """Balance of one year per region, one column per scenario."""
    return smb.where(F.col("yr") == year).groupBy("region").pivot("scenario", list(scenarios)).agg(F.first("smb"))


def decade_compare(smb: DataFrame, keys: Sequence[str], early: tuple[int, int], recent: tuple[int, int]) -> DataFrame:
    """Mean and population sd of two inclusive year ranges."""
    aggs = []
    for name, span in (("early", early), ("recent", recent)):
        v = F.when(F.col("yr").between(*span), F.col("smb"))
        aggs += [F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_sd")]
    return smb.groupBy(*keys).agg(*aggs)


def binned_response(df: DataFrame, x: str = "score", y: str = "smb") -> DataFrame:
    """Mean and population sd of y per distinct level of x, levels in order."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(
        F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"), F.count("*").alias("n")
    )


def drop_last_levels(levels: DataFrame, x: str, n: int) -> DataFrame:
    """Levels without the n highest (all stay if there are no more than n)."""
    if n <= 0:
        return levels
    top = settle(levels.select(x).orderBy(F.desc(x)).limit(n))
    total = levels.agg(F.count("*")).scalar()
    return levels.where(total <= n).unionByName(levels.where(total > n).join(top, x, "left_anti"))


def regional_mass_balance(df: DataFrame, keys: Sequence[str], value: str = "dmdtda") -> DataFrame:
    """Area-weighted rate over rows that have one; no area gives NULL."""
    v = F.col(value)
    area = F.sum(F.when(v.isNotNull(), F.col("area")))
    return df.groupBy(*keys).agg(
        F.when(area > 0, F.sum(v * F.col("area")) / area).alias("rate"), F.count(v).alias("n")
    )


def calibration_factors(obs: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed rate over (model rate / 0.85) per key."""
    o = obs.select(*keys, F.col("rate").alias("obs_rate"))
    m = model.select(*keys, F.col("rate").alias("model_rate"))
    ratio = F.col("obs_rate") / (F.col("model_rate") / RATE_SHARE)
    return o.join(m, list(keys)).withColumn("factor", F.when(F.col("model_rate") != 0, ratio))


def first_region(membership: DataFrame, key: str = "rgi_id") -> DataFrame:
    """The first region in order for each glacier (a min, not a sort)."""
    return membership.groupBy(key).agg(F.min_by("region", "region_order").alias("region"))


def calibrate_by_region(df: DataFrame, membership: DataFrame, factors: DataFrame, key: str = "rgi_id") -> DataFrame:
    """Multiply each glacier's rate once by the factor of its first region."""
    placed = df.join(first_region(membership, key), key).join(sized_broadcast(factors), "region")
    return placed.withColumn("calibrated", F.col("dmdtda") * F.col("factor"))


def calibration_report(calibrated: DataFrame) -> DataFrame:
    """Area-weighted mean per region before and after; zero area gives NULL."""
    v, c, a = F.col("dmdtda"), F.col("calibrated"), F.col("area")
    area = F.sum(F.when(v.isNotNull(), a))
    return calibrated.groupBy("region").agg(
        F.when(area > 0, F.sum(v * a) / area).alias("before"),
        F.when(area > 0, F.sum(c * a) / area).alias("after"),
    )


def geodetic_residual(model: DataFrame, ref: DataFrame) -> DataFrame:
    """One row: reference mean, model mean (smb - calving) and their difference.

    ``model``: rgi_id, smb, calving, area (mm, m2); ``ref``: rgi_id, dmdtda
    (m), area, is_cor.  Glaciers need both; measured references are preferred
    and the corrected ones are used only if there is no other.
    """
    m = model.dropna(subset=["smb", "calving", "area"]).select(
        "rgi_id", (F.col("smb") - F.col("calving")).alias("_net"), F.col("area").alias("_ma")
    )
    both = m.join(ref, "rgi_id")

    def mean(v, w, test):
        return F.try_divide(F.sum(F.when(test, v * w)), F.sum(F.when(test, w)))

    measured, every = ~F.col("is_cor"), F.lit(True)
    ref_mm, ra, net, ma = F.col("dmdtda") * 1000.0, F.col("area"), F.col("_net"), F.col("_ma")
    sums = both.agg(
        F.count_if(measured).alias("_k"),
        mean(ref_mm, ra, measured).alias("_r1"), mean(net, ma, measured).alias("_m1"),
        mean(ref_mm, ra, every).alias("_r2"), mean(net, ma, every).alias("_m2"),
    )
    pick = F.col("_k") > 0
    return sums.select(
        F.when(pick, F.col("_r1")).otherwise(F.col("_r2")).alias("reference"),
        F.when(pick, F.col("_m1")).otherwise(F.col("_m2")).alias("model"),
    ).withColumn("residual", F.col("reference") - F.col("model"))


def regional_residual(model: DataFrame, ref: DataFrame) -> DataFrame:
    """Residual per region against one regional reference rate (mm)."""
    m = model.dropna(subset=["smb", "calving", "area"]).groupBy("region").agg(
        weighted(F.col("smb") - F.col("calving"), F.col("area")).alias("model")
    )
    return m.join(sized_broadcast(ref), "region").withColumn("residual", F.col("reference") - F.col("model"))


def apply_bias_shift(params: DataFrame, residual: DataFrame) -> DataFrame:
    """bias - residual for every glacier, the old value kept; ``residual`` is one row."""
    shift = residual.agg(F.first("residual")).scalar()
    return params.withColumnRenamed("bias", "bias_before").withColumn("bias", F.col("bias_before") - shift)


# ---- assembly of run tables

def assemble_axis(df: DataFrame, key: str, axis: str, values: Sequence[str]) -> DataFrame:
    """Every id on the union of the time axes; missing steps are NULL.

    The axis is a calendar, so it is exploded from one short array per id
    instead of a cross join.
    """
    steps = df.select(axis).distinct().agg(F.sort_array(F.collect_set(axis))).scalar()
    full = df.select(key).distinct().select(key, steps.alias("_ax")).select(key, F.explode("_ax").alias(axis))
    return full.join(df.select(key, axis, *values), [key, axis], "left")


def assemble_climate(series: DataFrame, glaciers: DataFrame, values: Sequence[str] = ("temp", "prcp")) -> DataFrame:
    """All glaciers' monthly series on one axis with pixel attributes; no data stays NULL."""
    axis = series.select("yr", "mo").distinct().agg(F.sort_array(F.collect_set(F.struct("yr", "mo")))).scalar()
    full = glaciers.select("*", axis.alias("_ax")).select(*glaciers.columns, F.explode("_ax").alias("_t")).select(
        *glaciers.columns, "_t.yr", "_t.mo"
    )
    return full.join(series.select("glacier_id", "yr", "mo", *values), ["glacier_id", "yr", "mo"], "left")


def combine_members(members: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Add model and scenario keys and stack; columns may be missing in some members."""
    out = None
    for df, gcm, ssp in members:
        part = df.withColumn("gcm", F.lit(gcm)).withColumn("ssp", F.lit(ssp))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def concat_runs(first: DataFrame, second: DataFrame, key: str, cumulative: Sequence[str] = ()) -> DataFrame:
    """Drop the last step of run 1, append run 2; cumulative values carry on."""
    ends = first.groupBy(key).agg(
        F.max("yr").alias("_last"), *[F.max_by(c, "yr").alias(f"_c_{c}") for c in cumulative]
    )
    head = first.join(ends, key).where(F.col("yr") < F.col("_last"))
    tail = second.join(ends, key, "left")
    for c in cumulative:
        tail = tail.withColumn(c, F.col(c) + F.coalesce(F.col(f"_c_{c}"), F.lit(0.0)))
    return head.select(*first.columns).unionByName(tail.select(*first.columns))


def clip_run(df: DataFrame, t: int) -> DataFrame:
    return df.where(F.col("yr") <= t)


def percent_of_start(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """100 x / x(first year) per series."""
    start = df.groupBy(*keys).agg(F.min_by(value, "yr").alias("_x0"))
    return df.join(start, list(keys)).withColumn(
        "percent", F.when(F.col("_x0") != 0, F.col(value) / F.col("_x0") * 100)
    ).drop("_x0")


def first_year_below(percent: DataFrame, keys: Sequence[str], top: int = 90) -> DataFrame:
    """First year with percent <= cut for each cut top..0, NULL if never."""
    low = F.greatest(F.ceil("percent"), F.lit(0)).cast("int")
    reached = percent.where(F.col("percent") <= top).select(
        *keys, "yr", F.explode(F.sequence(low, F.lit(top))).alias("cut")
    ).groupBy(*keys, "cut").agg(F.min("yr").alias("year"))
    cuts = percent.select(*keys).distinct().withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return cuts.join(reached, [*keys, "cut"], "left")


def loss_summary(df: DataFrame, keys: Sequence[str], value: str, y0: int, y1: int, y2: int, relative: bool = True) -> DataFrame:
    """Loss y0..y1 and y1..y2, as a share of the start or as a difference."""

    def at(y):
        return F.max(F.when(F.col("yr") == y, F.col(value)))

    a, b, c = at(y0), at(y1), at(y2)
    first, second = ((1 - F.try_divide(b, a)), F.try_divide(b - c, a)) if relative else (a - b, b - c)
    return df.groupBy(*keys).agg(first.alias("loss_past"), second.alias("loss_future"))
