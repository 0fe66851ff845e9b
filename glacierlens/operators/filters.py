"""Projections and filters on footprints, glaciers and climate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glacierlens.functions import scalars as sc
from glacierlens.session import sized_broadcast


def bbox_filter(df: DataFrame, box: tuple[float, float, float, float], pad: float = 0.1,
                lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Padded lon/lat box as plain comparisons, so it reaches the file scan."""
    lon0, lat0, lon1, lat1 = box
    return df.where(F.col(lon).between(lon0 - pad, lon1 + pad) & F.col(lat).between(lat0 - pad, lat1 + pad))


def max_elev_filter(df: DataFrame, limit: float = 8900.0, col: str = "h_obs") -> DataFrame:
    return df.where(F.col(col) <= limit)


def dh_photon(df: DataFrame, max_abs: float = 200.0) -> DataFrame:
    """dh against the corrected terrain, dh_raw without corrections, cut at max_abs."""
    raw = F.col("h_obs") - F.col("geoid") - F.col("elev_ref")
    out = df.withColumn("dh_raw", raw).withColumn(
        "dh", F.col("h_obs") - F.col("geoid") - (F.col("elev_ref") + F.col("pdd") + F.col("vshift"))
    )
    return out.where(F.abs("dh") <= max_abs)


def dh_laser(df: DataFrame) -> DataFrame:
    """dh with ellipsoid offset and, where flagged 2, saturation correction; dh_pdd subtracts pdd."""
    sin_lat = F.sin(F.radians("lat"))
    offset = 0.8337 - 0.3848 * sin_lat * sin_lat
    sat = F.when(F.col("sat_flag") == 2, F.col("sat_corr")).otherwise(0.0)
    dh = F.col("h_obs") + sat - offset - F.col("geoid") - F.col("elev_ref")
    return df.withColumn("dh", dh).withColumn("dh_pdd", F.col("dh") - F.col("pdd"))


def dh_radar(df: DataFrame) -> DataFrame:
    return df.withColumn("dh", F.col("h_obs") - F.col("geoid") - (F.col("elev_ref") + F.col("pdd")))


def with_cell(df: DataFrame, size: float = 1.0, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Lower-left corner and centre of the grid cell."""
    s = float(size)
    return (
        df.withColumn("cell_lon", (F.floor(F.col(lon) / s) * s).cast("double"))
        .withColumn("cell_lat", (F.floor(F.col(lat) / s) * s).cast("double"))
        .withColumn("center_lon", F.col("cell_lon") + s / 2)
        .withColumn("center_lat", F.col("cell_lat") + s / 2)
    )


def cell_lookup(points: DataFrame, cells: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Add cell attributes by cell corner; 0 where the cell is unknown."""
    joined = with_cell(points).join(sized_broadcast(cells), ["cell_lon", "cell_lat"], "left")
    for a in attrs:
        joined = joined.withColumn(a, F.coalesce(F.col(a), F.lit(0.0)))
    return joined


def area_class(glaciers: DataFrame, runs: DataFrame, lo: float, hi: float, key: str = "glacier_id") -> DataFrame:
    """Runs of the glaciers with lo <= area < hi."""
    chosen = glaciers.where((F.col("area_km2") >= lo) & (F.col("area_km2") < hi))
    return runs.join(chosen, key, "left_semi")


def monthly_units(df: DataFrame) -> DataFrame:
    """K to degC, m/day to mm/month by real days, flux to mm/month by fixed days, geopotential to m."""
    date = F.make_date("yr", "mo", F.lit(1))
    return (
        df.withColumn("temp_c", sc.kelvin_to_celsius("temp_k"))
        .withColumn("prcp_mm", F.col("tp_m_day") * 1000.0 * sc.days_in_real_month(date))
        .withColumn("prcp_flux_mm", F.col("pr_flux") * sc.days_in_fixed_month("mo") * 86400.0)
        .withColumn("height_m", F.col("geopotential") / sc.STANDARD_GRAVITY)
    )


def offset_correct(df: DataFrame, corr: DataFrame, keys: Sequence[str], value: str = "dh") -> DataFrame:
    """Add the per-region offset of the mission; 0 where there is none."""
    joined = df.join(sized_broadcast(corr), list(keys), "left")
    return joined.withColumn(value, F.col(value) + F.coalesce(F.col("offset"), F.lit(0.0))).drop("offset")


def region_filter(df: DataFrame, regions: Sequence[int], col: str = "region") -> DataFrame:
    return df.where(F.col(col).isin(list(regions)))


def period_pick(df: DataFrame, period: str, col: str = "period") -> DataFrame:
    return df.where(F.col(col) == period)


def rescale_velocity(df: DataFrame) -> DataFrame:
    """Scale (vx, vy) back to the original speed where the new speed exceeds 1."""
    now, was = sc.speed("vx", "vy"), sc.speed("vx0", "vy0")
    factor = F.when(now > 1, was / now).otherwise(1.0)
    return df.withColumn("_f", factor).withColumn("vx", F.col("vx") * F.col("_f")).withColumn(
        "vy", F.col("vy") * F.col("_f")
    ).drop("_f")


def valid_glaciers(df: DataFrame, required: Sequence[DataFrame], key: str = "glacier_id") -> DataFrame:
    """Glaciers found in every required product."""
    for product in required:
        df = df.join(product, key, "left_semi")
    return df


def monthly_axis(spark: SparkSession, y0: int, y1: int | None = None, ny: int | None = None,
                 include_last_year: bool = False) -> DataFrame:
    """Float-year month axis; without the last year only its first month stays."""
    if y1 is None and ny is None:
        raise ValueError("give y1 or ny")
    years = (int(y1) - int(y0) + 1) if y1 is not None else int(ny)
    n = years * 12 - (0 if include_last_year else 11)
    i = F.col("id")
    return spark.range(n).select(
        (F.lit(int(y0)) + F.floor(i / 12)).cast("int").alias("yr"),
        (i % 12 + 1).cast("int").alias("mo"),
    ).withColumn("floatyear", sc.date_to_floatyear("yr", "mo"))


def finite(col: str) -> Column:
    c = F.col(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
