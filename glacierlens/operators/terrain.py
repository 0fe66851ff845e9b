"""Pixel tables of glaciers: gradients, hypsometry, elevation bands, quality.

Pixels: glacier_id, r, c, value (elevation) and what an operator names.  A
glacier's pixels are never gathered in one task: gradients use windows along
one raster line, everything else partial sums and distributed quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.quantiles import group_quantiles, group_ranks
from glacierlens.functions.regression import linear_trend
from glacierlens.functions.scalars import clip, speed, steady_sum
from glacierlens.session import attach, settle, stored

# fixed values: slope limits of the band geometry, volume-area scaling
MIN_SLOPE, MAX_SLOPE = math.radians(0.4), math.radians(60.0)
SCALING = (0.034, 1.375)


def _gradient(value: str, along: str, line: Window, dx: float) -> Column:
    """Central difference along a raster line, one-sided at the ends."""
    w = line.orderBy(along)
    prev, nxt, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    mid = (nxt - prev) / (2 * dx)
    return F.coalesce(mid, (nxt - here) / dx, (here - prev) / dx)


def slope_aspect(pixels: DataFrame, dx: float, value: str = "value") -> DataFrame:
    """sx, sy, slope and aspect (0..2 pi) per pixel; rasters are complete grids."""
    out = pixels.withColumn("sy", _gradient(value, "r", Window.partitionBy("glacier_id", "c"), dx))
    out = out.withColumn("sx", _gradient(value, "c", Window.partitionBy("glacier_id", "r"), dx))
    aspect = F.atan2(-F.col("sx"), F.col("sy"))
    return out.withColumn("slope", F.atan(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")))).withColumn(
        "aspect", F.when(aspect < 0, aspect + 2 * math.pi).otherwise(aspect)
    )


def hypsometry(pixels: DataFrame, bin_size: float = 50.0) -> DataFrame:
    """Per-mille of the pixels per elevation bin, integers that sum to 1000.

    All shares are rounded down, then those with the largest remainders up.
    """
    s = F.lit(float(bin_size))
    counts = pixels.groupBy("glacier_id", F.floor(F.col("value") / s).cast("long").alias("_b")).agg(F.count("*").alias("_n"))
    per = Window.partitionBy("glacier_id")
    h = F.col("_n") * 1000.0 / F.sum("_n").over(per)
    counts = counts.withColumn("_h", h).withColumn("_f", F.floor("_h").cast("long"))
    counts = counts.withColumn("_left", 1000 - F.sum("_f").over(per))
    order = per.orderBy(F.desc(F.col("_h") - F.col("_f")), "_b")
    up = (F.row_number().over(order) <= F.col("_left")) & (F.col("_h") > F.col("_f"))
    filled = counts.withColumn("permille", F.col("_f") + up.cast("int"))
    span = counts.groupBy("glacier_id").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    every = span.select("glacier_id", F.explode(F.sequence("_lo", "_hi")).alias("_b"))
    return every.join(filled, ["glacier_id", "_b"], "left").select(
        "glacier_id", ((F.col("_b") + 0.5) * s).alias("bin_center"),
        F.coalesce("permille", F.lit(0)).cast("int").alias("permille"),
    )


def hypsometry_summary(pixels: DataFrame, dx: float) -> DataFrame:
    """Zmin, Zmed, Zmax, mean slope and mean aspect in degrees."""
    sa = slope_aspect(pixels, dx)
    aspect = F.degrees(F.atan2(F.avg(-F.col("sx")), F.avg("sy")))
    out = sa.groupBy("glacier_id").agg(
        F.min("value").alias("z_min"), F.max("value").alias("z_max"),
        F.degrees(F.avg("slope")).alias("slope_deg"),
        F.when(aspect < 0, aspect + 360).otherwise(aspect).alias("aspect_deg"),
    )
    med = group_quantiles(pixels, ["glacier_id"], "value", {"z_med": 0.5}).drop("n")
    return out.join(med, "glacier_id")


def elevation_bins(pixels: DataFrame, dx: float, size: float = 30.0, variables: Sequence[str] = (),
                   preserve: Sequence[str] = ()) -> DataFrame:
    """Elevation-band flowline per glacier, from top to bottom.

    ``pixels`` carry slope (see :func:`slope_aspect`).  Glaciers with fewer
    than two bands take a third of the bin size; those still flat are left out.
    """
    clipped = clip("slope", MIN_SLOPE, MAX_SLOPE)
    ends = pixels.groupBy("glacier_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))

    def bands(step):
        return F.floor(F.col("_hi") / step) - F.floor(F.col("_lo") / step) + 1

    step = F.when(bands(size) >= 2, F.lit(float(size))).when(bands(size / 3) >= 2, F.lit(size / 3))
    sizes = settle(ends.select("glacier_id", step.alias("_step")).where(F.col("_step").isNotNull()))
    rows = attach(pixels, sizes, ["glacier_id"]).withColumn("_s", clipped).withColumn(
        "_b", F.floor(F.col("value") / F.col("_step")).cast("long")
    )
    # five passes follow, so the slopes (two window shuffles) are written once
    rows = stored(rows.select("glacier_id", "_b", "_step", "_s", "value", *variables), "pixels")
    keys = ["glacier_id", "_b"]
    q = group_quantiles(rows, keys, "_s", {"_q05": 0.05, "_q20": 0.2, "_q80": 0.8}).drop("n")
    share = clip(2 * F.col("_q20") / F.col("_q80"), 0.55, 0.95)
    q = settle(q.withColumn("_x", share))
    joined = attach(rows, q, keys)
    top = settle(group_quantiles(joined, [*keys, "_x"], "_s", {"_qx": F.col("_x")}).drop("n", "_x"))
    held = F.when(F.col("_s").between(F.col("_q05"), F.col("_qx")), F.col("_s"))
    out = attach(joined, top, keys).groupBy(*keys, "_step").agg(
        (F.count("*") * dx * dx).alias("area"),
        F.avg("value").alias("mean_elevation"),
        F.coalesce(F.avg(held), F.avg("_s")).alias("slope"),
        *[F.avg(v).alias(v) for v in variables],
    )
    out = out.withColumn("slope", clip("slope", MIN_SLOPE, MAX_SLOPE))
    out = out.withColumn("bin_elevation", (F.col("_b") + 0.5) * F.col("_step")).withColumn(
        "dx", F.col("_step") / F.tan("slope")
    ).withColumn("width", F.col("area") / F.col("dx"))
    if preserve:
        sums = pixels.groupBy("glacier_id").agg(*[(F.sum(v) * dx * dx).alias(f"_in_{v}") for v in preserve])
        out = out.join(sums, "glacier_id")
        per = Window.partitionBy("glacier_id")
        for v in preserve:
            total = F.sum(F.col(v) * F.col("area")).over(per)
            out = out.withColumn(v, F.when(total > 0, F.col(v) * F.col(f"_in_{v}") / total).otherwise(F.col(v))).drop(f"_in_{v}")
    down = Window.partitionBy("glacier_id").orderBy(F.desc("_b"))
    before = F.lag("dx").over(down)
    out = out.withColumn("_d", F.when(before.isNull(), F.col("dx") / 2).otherwise((F.col("dx") + before) / 2))
    return out.withColumn("distance", F.sum("_d").over(down)).drop("_b", "_d", "_step")


def dem_coverage(pixels: DataFrame, nodata: float = -999.0) -> DataFrame:
    """Share of valid glacier pixels per source and glacier; flat or empty sources left out.

    ``pixels``: source, glacier_id, value, mask.
    """
    valid = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") > nodata), F.col("value"))
    s = pixels.where("mask").groupBy("source", "glacier_id").agg(
        F.count("*").alias("_all"), F.count(valid).alias("_ok"), F.min(valid).alias("_lo"), F.max(valid).alias("_hi")
    )
    return s.where((F.col("_ok") > 0) & (F.col("_lo") != F.col("_hi"))).select(
        "source", "glacier_id", (F.col("_ok") / F.col("_all")).alias("coverage")
    )


def thickness_stats(pixels: DataFrame, areas: DataFrame, dx: float) -> DataFrame:
    """Volume, covered area and share, error volume, speeds, over glacier pixels.

    ``pixels``: glacier_id, mask, thick, thick_err, vx, vy, err_vx, err_vy; ``areas``: glacier_id, area_km2.
    """
    on = pixels.where("mask")
    v, e = speed("vx", "vy"), speed("err_vx", "err_vy")
    out = on.groupBy("glacier_id").agg(
        (F.coalesce(F.sum("thick"), F.lit(0.0)) * dx * dx * 1e-9).alias("vol_km3"),
        (F.count("thick") * dx * dx * 1e-6).alias("cov_area_km2"),
        (F.coalesce(F.sum("thick_err"), F.lit(0.0)) * dx * dx * 1e-9).alias("vol_err_km3"),
        F.avg(v).alias("avg_vel"), F.max(v).alias("max_vel"), F.avg(e).alias("avg_err_vel"),
    )
    return areas.join(out, "glacier_id", "left").select(
        *areas.columns,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("vol_km3", "cov_area_km2")],
        F.coalesce(F.try_divide("cov_area_km2", "area_km2"), F.lit(0.0)).alias("coverage"),
        "vol_err_km3", "avg_vel", "max_vel", "avg_err_vel",
    )


def glacier_statistics(glaciers: DataFrame, pixels: DataFrame | None = None, bins: DataFrame | None = None,
                       extra: Sequence[Column] = ()) -> DataFrame:
    """One row per glacier; a section whose table is missing leaves NULLs or no columns.

    Pixels: glacier_id, value, mask, ext (outline).  Bins: glacier_id, height,
    width, slope.  ``extra`` are aggregate expressions of the caller over the
    glacier's pixels.
    """
    a, b = SCALING
    out = glaciers.withColumn("vas_volume_km3", a * F.pow("area_km2", F.lit(b)))
    if pixels is not None:
        on = pixels.where("mask")
        top = pixels.where("ext").groupBy("glacier_id").agg(F.max("value").alias("_top"))
        dem = on.join(settle(top), "glacier_id", "left").groupBy("glacier_id").agg(
            F.avg("value").alias("dem_mean_elev"), F.min("value").alias("dem_min_elev"), F.max("value").alias("dem_max_elev"),
            F.max("_top").alias("dem_max_elev_on_ext"),
            F.avg((F.col("value") > F.col("_top")).cast("double")).alias("dem_share_above_ext"),
            *extra,
        )
        med = group_quantiles(on, ["glacier_id"], "value", {"dem_med_elev": 0.5}).drop("n")
        out = out.join(dem, "glacier_id", "left").join(med, "glacier_id", "left")
    if bins is not None:
        w = F.col("width")
        line = bins.groupBy("glacier_id").agg(
            (F.sum(w * F.col("height")) / F.sum(w)).alias("flowline_mean_elev"), F.min("height").alias("flowline_min_elev"),
            F.max("height").alias("flowline_max_elev"), F.avg("width").alias("flowline_avg_width"),
            F.avg("slope").alias("flowline_avg_slope"),
        )
        out = out.join(line, "glacier_id", "left")
    return out


def conserve_total(df: DataFrame, keys: Sequence[str], value: str, targets: DataFrame, cell: float = 1.0) -> DataFrame:
    """Rescale a field so that sum * cell is the key's target; negative and zero become NULL."""
    keys = list(keys)
    pos = clip(value, lo=0.0)
    sums = df.groupBy(*keys).agg((steady_sum(pos) * cell).alias("_sum")).join(targets, keys)
    ratio = F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(1.0)
    scaled = df.join(settle(sums.select(*keys, ratio.alias("_k"))), keys).withColumn("_v", pos * F.col("_k"))
    return scaled.withColumn(value, F.when(F.col("_v") != 0, F.col("_v"))).drop("_k", "_v")


def local_lapse_rate(df: DataFrame, keys: Sequence[str], height: str, temp: str, p_max: float = 0.01, min_n: int = 5) -> DataFrame:
    """Slope of temperature on height; NULL unless significant with enough points."""
    t = linear_trend(df, keys, height, temp)
    ok = (F.col("p") < p_max) & (F.col("n") >= min_n)
    return t.select(*keys, "n", F.when(ok, F.col("slope")).alias("gradient"))


def rank_in_band(pixels: DataFrame, bands: DataFrame, elev: str = "value", thick: str = "thick") -> DataFrame:
    """Elevation band of each pixel and its rank in the band.

    ``bands``: glacier_id, band (0 at the top), n_pixels.  Pixels are ranked by
    elevation; band k takes the ranks below the sum of the counts from k on.
    The rank in the band weighs thickness with height.
    """
    ranked = group_ranks(pixels, ["glacier_id"], elev, "_rank")
    low = ranked.groupBy("glacier_id").agg(F.min(elev).alias("_zmin"))
    from_here = F.sum("n_pixels").over(Window.partitionBy("glacier_id").orderBy(F.desc("band")))
    bounds = bands.withColumn("_u", F.round(from_here)).where(F.col("band") > 0).groupBy("glacier_id").agg(
        F.collect_list("_u").alias("_us")
    )
    lookup = settle(low.join(bounds, "glacier_id", "left"))
    j = ranked.join(lookup, "glacier_id")
    # bands below the top one whose upper bound lies above the rank
    below = F.size(F.filter(F.coalesce("_us", F.array().cast("array<double>")), lambda u: u > F.col("_rank")))
    j = j.withColumn("band", below.cast("int")).withColumn(
        "_w", (F.col(elev) - F.col("_zmin") + 1) * 1.003 * F.col(thick)
    )
    out = group_ranks(j, ["glacier_id", "band"], "_w", "rank_in_band")
    return out.select(*pixels.columns, F.col("_rank").alias("rank"), "band", "rank_in_band")


