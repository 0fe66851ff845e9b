"""Temperature-index mass balance: climate on height, balance, ELA, calibration.

Monthly climate: glacier_id, yr, mo, temp, prcp and optionally gradient.
Parameters: glacier_id, ref_hgt, mu, bias.  Bins: glacier_id, bin_id, height,
width.  A glacier's months are bounded by the record, its bins are not: they are
dealt by their own ids, and sums combine before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glacierlens.functions.scalars import SECONDS_IN_MONTH, SECONDS_IN_YEAR, clip
from glacierlens.operators.series import snow_bucket
from glacierlens.session import attach, settle, sized_broadcast


@dataclass(frozen=True)
class Physics:
    """Fixed values of the temperature-index model."""

    t_solid: float = 0.0
    t_liq: float = 2.0
    t_melt: float = -1.0
    gradient: float = -0.0065
    gradient_bounds: tuple[float, float] = (-0.009, -0.003)
    prcp_factor: float = 2.5
    height_bounds: tuple[float, float] = (-1e4, 2e4)


DEFAULT = Physics()
# one bit per month of a full year
ALL_MONTHS = (1 << 12) - 1
# points (bins times months) that one task makes
POINTS_A_TASK = 500_000


def lapse(df: DataFrame, ph: Physics = DEFAULT) -> Column:
    """Local gradient, default where missing, within its bounds."""
    if "gradient" not in df.columns:
        return F.lit(ph.gradient)
    g = F.when(F.col("gradient").isNull() | F.isnan("gradient"), F.lit(ph.gradient)).otherwise(F.col("gradient"))
    return clip(g, *ph.gradient_bounds)


def point_terms(temp: Column, prcp: Column, ph: Physics = DEFAULT) -> tuple[Column, Column]:
    """(melt temperature, solid precipitation) at a point."""
    melt = clip(temp - ph.t_melt, lo=0.0)
    share = 1 - (temp - ph.t_solid) / (ph.t_liq - ph.t_solid)
    return melt, prcp * clip(share, 0.0, 1.0)


def merge_bins(bins: DataFrame) -> DataFrame:
    """Bins of equal height count once with their summed width."""
    return bins.where(F.col("width") > 0).groupBy("glacier_id", "height").agg(F.sum("width").alias("width"))


def _dealt(bins: DataFrame, months: DataFrame) -> DataFrame:
    """Bins in as many tasks as their points need; sums by bin go on in the same tasks."""
    record = months.groupBy("glacier_id").count().agg(F.max("count")).first()[0] or 0
    tasks = math.ceil(bins.count() * record / POINTS_A_TASK)
    if tasks < 2:
        return bins
    return bins.repartition(tasks, *(["glacier_id", "bin_id"] if "bin_id" in bins.columns else bins.columns))


def climate_on_height(climate: DataFrame, params: DataFrame, bins: DataFrame, ph: Physics = DEFAULT) -> DataFrame:
    """Temperature, melt, precipitation and snow per bin and month.

    The months go to the bins by a size-checked broadcast, and the bins are dealt by their own
    ids: a join on the glacier alone would make all points of a glacier in one task.
    """
    months = settle(climate.withColumn("_g", lapse(climate, ph)).join(params, "glacier_id"))
    dealt = _dealt(bins, months) if months.fits_broadcast else bins
    t = F.col("temp") + F.col("_g") * (F.col("height") - F.col("ref_hgt"))
    p = F.col("prcp") * ph.prcp_factor
    out = attach(dealt, months, ["glacier_id"]).withColumn("_t", t).withColumn("_p", p)
    melt, snow = point_terms(F.col("_t"), F.col("_p"), ph)
    return out.withColumn("melt", melt).withColumn("snow", snow).drop("temp", "prcp", "_g", "gradient").withColumnRenamed(
        "_t", "temp"
    ).withColumnRenamed("_p", "prcp")


def yearly_climate_on_height(points: DataFrame, flatten: bool = False) -> DataFrame:
    """Annual sums of melt and snow of full years, per bin or of the mean over bins."""
    if flatten:
        monthly = points.groupBy("glacier_id", "yr", "mo").agg(F.avg("melt").alias("melt"), F.avg("snow").alias("snow"))
        keys = ["glacier_id", "yr"]
    else:
        monthly, keys = points, ["glacier_id", "bin_id", "height", "yr"]
    return monthly.groupBy(*keys).agg(
        F.sum("melt").alias("melt"), F.sum("snow").alias("snow"), F.count(F.col("melt") + F.col("snow")).alias("_n")
    ).where(F.col("_n") == 12).drop("_n")


def glacier_climate(climate: DataFrame, params: DataFrame, bins: DataFrame, ph: Physics = DEFAULT) -> DataFrame:
    """Width-weighted annual sums of full years, in one aggregation."""
    pts = climate_on_height(climate, params, merge_bins(bins), ph)
    w = F.col("width")
    return pts.groupBy("glacier_id", "yr").agg(
        (F.sum(w * F.col("melt")) / F.sum(w) * 12).alias("temp"),
        (F.sum(w * F.col("snow")) / F.sum(w) * 12).alias("prcp"),
        F.expr("bit_or(if(melt + snow is null, 0, shiftleft(1, mo - 1)))").alias("_m"),
    ).where(F.col("_m") == ALL_MONTHS).drop("_m")


def point_balance(points: DataFrame, annual: bool = False) -> DataFrame:
    """snow - mu*melt - bias per bin and month (bias by month length) or full year."""
    if not annual:
        share = SECONDS_IN_MONTH / SECONDS_IN_YEAR
        return points.withColumn("mb", F.col("snow") - F.col("mu") * F.col("melt") - F.col("bias") * share)
    sums = points.groupBy("glacier_id", "bin_id", "height", "width", "yr", "mu", "bias").agg(
        F.sum("melt").alias("melt"), F.sum("snow").alias("snow"), F.count(F.col("melt") + F.col("snow")).alias("_n")
    )
    return sums.where(F.col("_n") == 12).drop("_n").withColumn(
        "mb", F.col("snow") - F.col("mu") * F.col("melt") - F.col("bias")
    )


def linear_balance(bins: DataFrame, ela: DataFrame, grad: float = 3.0, max_mb: float | None = None,
                   temp_bias: float = 0.0) -> DataFrame:
    """(z - ela) * grad, capped; one degree lifts the ELA by 150 m."""
    mb = (F.col("height") - (F.col("ela") + 150.0 * temp_bias)) * grad
    if max_mb is not None:
        mb = clip(mb, hi=float(max_mb))
    return bins.join(ela, "glacier_id").withColumn("mb", mb)


def specific_mb(climate: DataFrame, params: DataFrame, bins: DataFrame, ph: Physics = DEFAULT) -> DataFrame:
    """Width-weighted annual balance per glacier."""
    yearly = glacier_climate(climate, params, bins, ph)
    return yearly.join(params, "glacier_id").select(
        "glacier_id", "yr", (F.col("prcp") - F.col("mu") * F.col("temp") - F.col("bias")).alias("mb")
    )


def constant_climate_balance(climate: DataFrame, params: DataFrame, bins: DataFrame, y0: int, half: int,
                             mean_first: bool = False, ph: Physics = DEFAULT) -> DataFrame:
    """Balance per bin of the 2*half+1 years around y0.

    The mean of the point climate of all years, or the balance of the mean climate.
    """
    window = climate.where(F.col("yr").between(y0 - half, y0 + half))
    if mean_first:
        cols = [F.avg(c).alias(c) for c in ("temp", "prcp", "gradient") if c in climate.columns]
        window = window.groupBy("glacier_id", "mo").agg(*cols)
        pts = climate_on_height(window, params, bins, ph)
    else:
        pts = climate_on_height(window, params, bins, ph).groupBy(
            "glacier_id", "bin_id", "height", "width", "mu", "bias", "mo"
        ).agg(*[F.avg(c).alias(c) for c in ("temp", "melt", "prcp", "snow")])
    return pts.groupBy("glacier_id", "bin_id", "height", "width", "mu", "bias").agg(
        F.avg("temp").alias("temp"), F.sum("melt").alias("melt"), F.sum("prcp").alias("prcp"), F.sum("snow").alias("snow")
    ).withColumn("mb", F.col("snow") - F.col("mu") * F.col("melt") - F.col("bias"))


def equilibrium_line(climate: DataFrame, params: DataFrame, keys: Sequence[str] = ("yr",), years: int = 1,
                     ph: Physics = DEFAULT) -> DataFrame:
    """Height of zero annual balance per glacier and key of full years; NULL if there is none.

    With fixed gradients the balance is piecewise linear in height, with kinks
    where a month reaches a threshold temperature.  The kinks of the (at most
    12 * years) months are sorted, the balance is evaluated there, and the
    crossing is interpolated in its linear piece, so the root is exact.
    """
    lo, hi = ph.height_bounds
    c = climate.withColumn("_g", lapse(climate, ph))
    months = c.groupBy("glacier_id", *keys).agg(
        F.collect_list(F.struct(F.col("temp").alias("t"), (F.col("prcp") * ph.prcp_factor).alias("p"), F.col("_g").alias("g"))).alias("_ms"),
        F.count(F.col("temp") + F.col("prcp")).alias("_n"),
    ).where(F.col("_n") == 12 * years).join(params, "glacier_id")
    ref = F.col("ref_hgt")
    kinks = F.flatten(F.transform("_ms", lambda m: F.array(*[
        ref + (F.lit(limit) - m["t"]) / m["g"] for limit in (ph.t_melt, ph.t_solid, ph.t_liq)
    ])))
    inner = F.filter(kinks, lambda z: (z > lo) & (z < hi))
    heights = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(lo), F.lit(hi)), inner)))

    def balance(z):
        def one(acc, m):
            melt, snow = point_terms(m["t"] + m["g"] * (z - ref), m["p"], ph)
            return acc + snow - F.col("mu") * melt

        return F.aggregate("_ms", F.lit(0.0), one) / float(years) - F.col("bias")

    b = months.withColumn("_z", heights).withColumn("_b", F.transform("_z", balance))
    # last height with a negative balance starts the crossing piece
    idx = F.array_max(F.transform("_b", lambda x, i: F.when(x < 0, i)))
    b = b.withColumn("_i", F.coalesce(idx, F.lit(0)))
    z0, z1 = F.get("_z", F.col("_i")), F.get("_z", F.col("_i") + 1)
    b0, b1 = F.get("_b", F.col("_i")), F.get("_b", F.col("_i") + 1)
    root = F.when(b0 >= 0, z0).otherwise(z0 + (z1 - z0) * (-b0) / (b1 - b0))
    bad = (F.element_at("_b", 1) > 0) | (F.element_at("_b", -1) < 0)
    return b.select("glacier_id", *keys, F.when(~bad, root).alias("ela"))


def ela_of_flowlines(elas: DataFrame, areas: DataFrame, keys: Sequence[str] = ("glacier_id", "yr")) -> DataFrame:
    """Area-weighted ELA over the flowlines of a glacier; NULL if any is missing."""
    j = elas.join(areas, ["glacier_id", "flowline"])
    return j.groupBy(*keys).agg(
        F.when(F.count("ela") == F.count("*"), F.sum(F.col("ela") * F.col("area")) / F.sum("area")).alias("ela")
    )


# ---- random and perturbed years

def hash_uniform(*parts: Column) -> Column:
    """Number in (0, 1) from the md5 of the parts; the same on every executor."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hash_normal(seed: int, name: str, key: Column) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    u = hash_uniform(F.lit(seed), F.lit(name), F.lit("a"), key)
    v = hash_uniform(F.lit(seed), F.lit(name), F.lit("b"), key)
    return F.sqrt(-2.0 * F.ln(u)) * F.cos(2.0 * math.pi * v)


def random_years(spark: SparkSession, start: int, n: int, years: Sequence[int], seed: int, unique: bool = True) -> DataFrame:
    """Map from simulated year to a year of the window.

    ``unique`` draws every year once per cycle before any is drawn again.
    """
    pool, k = list(years), len(years)
    sim = spark.range(n).select((F.col("id") + start).cast("int").alias("sim_year"), F.col("id").alias("_i"))
    if unique:
        cycle = F.floor(F.col("_i") / k)
        shuffled = F.array_sort(F.array(*[
            F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), cycle.cast("string"), F.lit(str(y)))).alias("h"), F.lit(y).alias("y"))
            for y in pool
        ]))
        chosen = F.get(shuffled, (F.col("_i") % k).cast("int"))["y"]
    else:
        pick = F.floor(hash_uniform(F.lit(seed), F.col("sim_year")) * k).cast("int")
        chosen = F.get(F.array(*[F.lit(y) for y in pool]), pick)
    return sim.select("sim_year", chosen.cast("int").alias("yr"))


def random_climate_balance(balance: DataFrame, year_map: DataFrame) -> DataFrame:
    """Annual balance of each simulated year; the year map is a calendar."""
    return balance.join(sized_broadcast(year_map), "yr").select("glacier_id", "sim_year", "yr", "mb")


def perturbed_balance(climate: DataFrame, params: DataFrame, bins: DataFrame, seed: int, temp_sigma: float = 0.1,
                      prcp_sigma: float = 0.1, bias_sigma: float = 100.0, ph: Physics = DEFAULT) -> DataFrame:
    """Annual balance with a gaussian offset per year on temp, prcp factor and bias."""
    c = climate.withColumn("temp", F.col("temp") + temp_sigma * hash_normal(seed, "temp", F.col("yr")))
    factor = ph.prcp_factor + prcp_sigma * hash_normal(seed, "prcp", F.col("yr"))
    c = c.withColumn("prcp", F.col("prcp") * factor / ph.prcp_factor)
    mb = specific_mb(c, params, bins, ph)
    return mb.withColumn("mb", F.col("mb") - bias_sigma * hash_normal(seed, "bias", F.col("yr")))


# ---- calibration

def _rates(climate, heights, bins, ph):
    """Mean over years of the weighted snow (_p) and melt (_t) per candidate height."""
    pts = climate_on_height(climate, heights, bins, ph)
    w = F.col("width")
    return pts.groupBy("glacier_id", "k").agg(
        (F.sum(w * F.col("snow")) / F.sum(w) * 12).alias("_p"), (F.sum(w * F.col("melt")) / F.sum(w) * 12).alias("_t")
    )


def calibrate_mu(climate: DataFrame, params: DataFrame, bins: DataFrame, ref: DataFrame, y0: int, y1: int,
                 min_mu: float = 75.0, max_mu: float = 500.0, step: float = 25.0, max_change: float = 5000.0,
                 ph: Physics = DEFAULT) -> DataFrame:
    """mu with mean(snow - mu*melt) = ref_mb over the full years y0..y1.

    The balance is linear in mu, so mu = (P - ref) / T.  Where it falls outside
    [min_mu, max_mu] the reference height moves in steps until it fits, the
    smallest change first.  mu changes monotonically with the height, so a
    coarse pass over every 16th step brackets the first fit and a second pass
    over the 16 steps before it finds it.
    """
    period = climate.where(F.col("yr").between(y0, y1))
    b = merge_bins(bins)
    base = params.select("glacier_id", "ref_hgt", F.lit(0).alias("k"))
    start = _rates(period, base, b, ph).drop("k").join(ref, "glacier_id").join(params.select("glacier_id", "ref_hgt"), "glacier_id")
    mu = F.when(F.col("_t") > 0, (F.col("_p") - F.col("ref_mb")) / F.col("_t"))
    fits = mu.between(min_mu, max_mu)
    # too negative even with the smallest mu: cool (lower the height)
    cool = F.col("_p") - min_mu * F.col("_t") - F.col("ref_mb") < 0
    start = start.withColumn("mu", F.when(fits, mu)).withColumn("sign", F.when(cool, -1).otherwise(1))
    good = start.where(F.col("mu").isNotNull()).select("glacier_id", "mu", F.col("ref_hgt").alias("calib_hgt"), F.lit(0.0).alias("hgt_change"))

    open_ = start.where(F.col("mu").isNull()).select("glacier_id", "ref_hgt", "ref_mb", "sign")
    last = int(max_change / step) - 1
    stride = 16

    def evaluate(cands):
        moved = cands.select("glacier_id", "k", (F.col("ref_hgt") + F.col("sign") * step * F.col("k")).alias("ref_hgt"))
        r = _rates(period, moved, b, ph).join(open_, "glacier_id")
        # the side of the allowed interval a search comes from
        reached = F.when(F.col("sign") > 0, F.col("_p") - max_mu * F.col("_t") - F.col("ref_mb") <= 0).otherwise(
            F.col("_p") - min_mu * F.col("_t") - F.col("ref_mb") >= 0
        )
        return r.withColumn("_mu", mu).withColumn("_hit", reached)

    coarse = open_.withColumn("k", F.explode(F.concat(F.sequence(F.lit(0), F.lit(last), F.lit(stride)), F.array(F.lit(last)))))
    first = evaluate(coarse).where("_hit").groupBy("glacier_id").agg(F.min("k").alias("_k"))
    fine = open_.join(first, "glacier_id").withColumn(
        "k", F.explode(F.sequence(F.greatest(F.col("_k") - stride + 1, F.lit(0)), F.col("_k")))
    )
    found = evaluate(fine).where("_hit").groupBy("glacier_id").agg(F.min(F.struct("k", "_mu", "ref_hgt", "sign")).alias("_f"))
    moved = found.where(F.col("_f._mu").between(min_mu, max_mu)).select(
        "glacier_id", F.col("_f._mu").alias("mu"),
        (F.col("_f.ref_hgt") + F.col("_f.sign") * step * F.col("_f.k")).alias("calib_hgt"),
        (F.col("_f.sign") * step * F.col("_f.k")).alias("hgt_change"),
    )
    done = good.unionByName(moved)
    return ref.select("glacier_id", "ref_mb").join(done, "glacier_id", "left")


def climate_qc(climate: DataFrame, params: DataFrame, bins: DataFrame, n_months: int, ph: Physics = DEFAULT) -> DataFrame:
    """Shift of the reference height (10 m steps) for n melt months at the bottom
    every year, else for n accumulation months at the top.

    The n-th warmest (coldest) month of each year fixes the shift, so no loop.
    Years with a missing month don't count.
    """
    t_snow = (ph.t_liq + ph.t_solid) / 2
    per_year = climate.groupBy("glacier_id", "yr").agg(
        F.sort_array(F.collect_list("temp"), asc=False).alias("_d")
    ).where(F.size("_d") == 12).select(
        "glacier_id", F.get("_d", F.lit(n_months - 1)).alias("_warm"),
        F.get("_d", F.size("_d") - n_months).alias("_cold"),
    )
    worst = per_year.groupBy("glacier_id").agg(F.min("_warm").alias("_warm"), F.max("_cold").alias("_cold"))
    ends = bins.groupBy("glacier_id").agg(F.min("height").alias("_bot"), F.max("height").alias("_top"))
    j = worst.join(ends, "glacier_id").join(params.select("glacier_id", "ref_hgt"), "glacier_id")
    per_step = -ph.gradient * 10

    def steps(missing):
        return F.when(missing >= 0, F.floor(missing / per_step) + 1).otherwise(0)

    up = steps(ph.t_melt - F.col("_warm") - ph.gradient * (F.col("_bot") - F.col("ref_hgt")))
    down = steps(F.col("_cold") + ph.gradient * (F.col("_top") - F.col("ref_hgt")) - t_snow)
    diff = F.when(up > 0, up * 10).otherwise(-down * 10).cast("double")
    return j.select(
        "glacier_id", F.col("ref_hgt").alias("uncorrected_ref_hgt"), (F.col("ref_hgt") + diff).alias("ref_hgt"),
        diff.alias("ref_hgt_diff"),
    )


def climate_normals(climate: DataFrame, params: DataFrame, bins: DataFrame, y0: int, half: int,
                    ph: Physics = DEFAULT) -> DataFrame:
    """Accumulation-area ratio, gradient below the ELA, ELA, and mean climate at
    the ELA, mean, top and bottom heights of the glacier."""
    n = 2 * half + 1
    # three passes read the months, two the few rows of the glaciers
    window = settle(climate.where(F.col("yr").between(y0 - half, y0 + half)))
    mb = constant_climate_balance(window, params, bins, y0, half, ph=ph)
    w, z = F.col("width"), F.col("height")
    below = F.col("mb") < 0
    shape = mb.groupBy("glacier_id").agg(
        (F.sum(F.when(~below, w).otherwise(0.0)) / F.sum(w)).alias("aar"),
        F.regr_slope(F.when(below, F.col("mb")), F.when(below, z)).alias("mb_grad"),
        (F.sum(w * z) / F.sum(w)).alias("mean_elev"), F.max(z).alias("max_elev"), F.min(z).alias("min_elev"),
    )
    ela = equilibrium_line(window, params, keys=(), years=n, ph=ph)
    heads = settle(shape.join(ela, "glacier_id", "left"))
    names = ("ela", "mean_elev", "max_elev", "min_elev")
    spots = heads.unpivot("glacier_id", [c for c in names], "bin_id", "height").where(F.col("height").isNotNull()).withColumn("width", F.lit(1.0))
    at = climate_on_height(window, params, spots, ph).groupBy("glacier_id", "bin_id").agg(
        F.avg("temp").alias("temp"), (F.sum("melt") / n).alias("melt"), (F.sum("snow") / n).alias("snow")
    )
    wide = at.groupBy("glacier_id").pivot("bin_id", list(names)).agg(
        F.first("temp").alias("temp"), F.first("melt").alias("melt"), F.first("snow").alias("snow")
    )
    return heads.join(wide, "glacier_id", "left")


# ---- runoff

def runoff_components(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Monthly melt, snow and rain on and off the glacier per year and month.

    ``points``: climate_on_height rows with mu and bias; ``areas``: glacier_id,
    bin_id, bin_area, ref_area.  Melt is snow minus balance, not negative where
    the bias is 0; off the glacier it is limited by the snow bucket of the bin.
    """
    share = SECONDS_IN_MONTH / SECONDS_IN_YEAR
    j = point_balance(points).join(areas, ["glacier_id", "bin_id"])
    off = clip(F.col("ref_area") - F.col("bin_area"), lo=0.0)
    j = j.withColumn("_off", off).withColumn("_melt", F.col("snow") - F.col("mb"))
    j = j.withColumn("_melt", F.when(F.col("bias") == 0, clip("_melt", lo=0.0)).otherwise(F.col("_melt")))
    j = j.withColumn("_snow_off", F.col("snow") * F.col("_off")).withColumn("_melt_off", F.col("_melt") * F.col("_off"))
    j = snow_bucket(j, ["glacier_id", "bin_id"], ["yr", "mo"], "_snow_off", "_melt_off")
    rain = F.col("prcp") - F.col("snow")
    return j.groupBy("glacier_id", "yr", "mo").agg(
        F.sum("melt_limited").alias("melt_off"),
        F.sum(F.col("_melt") * F.col("bin_area")).alias("melt_on"),
        F.sum(F.col("bias") * share * F.col("_off")).alias("residual_off"),
        F.sum(F.col("bias") * share * F.col("bin_area")).alias("residual_on"),
        F.sum(rain * F.col("_off")).alias("rain_off"),
        F.sum(rain * F.col("bin_area")).alias("rain_on"),
        F.sum("_snow_off").alias("snow_off"),
        F.sum(F.col("snow") * F.col("bin_area")).alias("snow_on"),
        F.sum("bucket").alias("snow_bucket"),
    )


# ---- observed balances

def reference_mb_window(observed: DataFrame, y0: int, y1: int) -> DataFrame:
    """Observed annual balances of a year window, missing years dropped."""
    return observed.where(F.col("yr").between(y0, y1) & F.col("mb").isNotNull())


def mb_profile(profiles: DataFrame, y0: int, y1: int, ratio: float) -> DataFrame:
    """Profile values of bands observed in at least ``ratio`` of the years with any observation."""
    rows = profiles.where(F.col("yr").between(y0, y1) & F.col("mb").isNotNull())
    years = rows.groupBy("glacier_id").agg(F.countDistinct("yr").alias("_y"))
    bands = rows.groupBy("glacier_id", "band").agg(F.countDistinct("yr").alias("_k"))
    keep = bands.join(years, "glacier_id").where(F.col("_k") / F.col("_y") >= ratio).select("glacier_id", "band")
    return rows.join(keep, ["glacier_id", "band"], "left_semi")
