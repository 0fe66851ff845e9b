"""Robust statistics of height change by region, window and elevation band."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glacierlens.functions.quantiles import group_quantiles
from glacierlens.session import attach, settle, sized_broadcast, stored


@dataclass(frozen=True)
class Screen:
    """Two-step outlier screen of one mission.

    ``from_survivors``: step 2 keeps rows that passed step 1; otherwise it is
    applied to the base rows and only the median comes from step 1, so a row
    beyond the first cut but near the median returns.
    """

    first: float
    second: float
    min_n: int
    from_survivors: bool
    max_slope: float = 40.0
    flag: str | None = "quality_flag"

    def base(self) -> Column:
        ok = F.col("slope_deg") <= self.max_slope
        return ok & (F.col(self.flag) == 0) if self.flag else ok


# fixed values: cuts and minimum counts per mission
PHOTON = Screen(150, 75, 101, True)
PHOTON_CELL = Screen(150, 75, 1, True)
LASER = Screen(100, 50, 1, False)
LASER_CELL = Screen(100, 50, 10, False)
RADAR = Screen(150, 75, 30, False, flag=None)


def sample_se(col: str) -> Column:
    """Standard error over all rows; one row has no spread and gives 0."""
    return F.coalesce(F.stddev_samp(col), F.lit(0.0)) / F.sqrt(F.count("*"))


HIERARCHIES = ("all", "r15", "r22", "tp", "cell")


# what a region set is named by; the finest key of all sets
REGIONS = {"all": None, "r15": "region15", "r22": "region22", "tp": "tp_flag", "cell": "cell"}


def _cell() -> Column:
    return (F.floor("lon") * 1000 + F.floor("lat")).cast("int")


def with_cell(df: DataFrame) -> DataFrame:
    """Rows with the number of their one-degree cell."""
    return df.withColumn("cell", _cell())


def finest(wanted: Sequence[str] = HIERARCHIES) -> list[str]:
    """Columns that tell a row's region in all wanted sets."""
    return [REGIONS[h] for h in wanted if REGIONS[h]]


def hierarchies(df: DataFrame, wanted: Sequence[str] = HIERARCHIES) -> DataFrame:
    """Every row once per wanted region set it belongs to (all, 15, 22, plateau, cell).

    One explode and one later groupBy; rows must be filtered before.  Partial
    aggregates with the columns of :func:`with_cell` may be multiplied instead of rows.
    """
    region = {
        "all": lambda: F.lit(0),
        "r15": lambda: F.col("region15").cast("int"),
        "r22": lambda: F.col("region22").cast("int"),
        "tp": lambda: F.when(F.col("tp_flag") == 1, F.lit(0)),
        "cell": lambda: F.col("cell") if "cell" in df.columns else _cell(),
    }
    tags = F.array(*[F.struct(F.lit(h).alias("hier"), region[h]().alias("region_id")) for h in wanted])
    kept = F.filter(tags, lambda t: t["region_id"].isNotNull())
    return df.withColumn("_t", F.explode(kept)).select("*", "_t.hier", "_t.region_id").drop("_t")


def screened(df: DataFrame, keys: Sequence[str], screen: Screen) -> tuple[DataFrame, DataFrame]:
    """(rows after both steps with ``med``, one row per key with ``med`` and ``n_first``)."""
    keys = list(keys)
    base = df.where(screen.base() & F.col("dh").isNotNull())
    first = base.where(F.abs("dh") < screen.first)
    med = settle(
        group_quantiles(first, keys, "dh", {"med": 0.5}).withColumnRenamed("n", "n_first")
    )
    rows = first if screen.from_survivors else base
    kept = attach(rows, med, keys).where(F.abs(F.col("dh") - F.col("med")) < screen.second)
    return kept, med


def robust_stats(df: DataFrame, keys: Sequence[str], screen: Screen) -> DataFrame:
    """mean, n, se after the screen; too few rows give NULL, 0, NULL."""
    keys = list(keys)
    kept, med = screened(df, keys, screen)
    stats = kept.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("dh").alias("mean"), sample_se("dh").alias("se")
    )
    enough = F.coalesce(F.col("n"), F.lit(0)) >= screen.min_n
    return med.select(*keys).join(stats, keys, "left").select(
        *keys,
        F.when(enough, F.col("mean")).alias("mean"),
        F.when(enough, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n"),
        F.when(enough, F.col("se")).alias("se"),
    )


def summary10(df: DataFrame, keys: Sequence[str], screen: Screen) -> DataFrame:
    """Ten summary values per key after the screen, quartiles by the midpoint rule."""
    keys = list(keys)
    kept, _ = screened(df, keys, screen)
    # the moments and each quartile pass read the rows again, so the screen's join runs once
    kept = stored(kept.select(*keys, "n_first", "dh"), "screened")
    moments = kept.groupBy(*keys, "n_first").agg(
        F.count("*").alias("n"),
        F.avg("dh").alias("mean"),
        F.coalesce(F.stddev_samp("dh"), F.lit(0.0)).alias("sd"),
        sample_se("dh").alias("se"),
        F.min("dh").alias("min"),
        F.max("dh").alias("max"),
    )
    quart = group_quantiles(
        kept, keys, "dh", {"p25": 0.25, "median": 0.5, "p75": 0.75}, kind="midpoint"
    ).drop("n")
    return moments.join(quart, keys)


def percentile_bounds(df: DataFrame, keys: Sequence[str], p: float = 1.0) -> DataFrame:
    """p-th, (100-p)-th percentile and median per key, midpoint rule."""
    return group_quantiles(
        df, keys, "dh", {"low": p / 100, "high": 1 - p / 100, "median": 0.5}, kind="midpoint"
    )


def in_bands(
    df: DataFrame,
    cut: float = 120.0,
    max_slope: float = 40.0,
    strict_slope: bool = False,
    flag: str | None = "quality_flag",
    width: float = 100.0,
    low: float = 2200.0,
    high: float = 8800.0,
) -> DataFrame:
    """Rows that count in elevation bands, with ``band_center``."""
    slope = F.col("slope_deg") < max_slope if strict_slope else F.col("slope_deg") <= max_slope
    ok = slope & (F.abs("dh") < cut) & (F.col("elev_ref") >= low) & (F.col("elev_ref") < high)
    if flag:
        ok = ok & (F.col(flag) == 0)
    center = (F.floor((F.col("elev_ref") - low) / width) * width + low + width / 2).cast("int")
    return df.where(ok).withColumn("band_center", center)


def band_stats(
    df: DataFrame,
    keys: Sequence[str],
    cut: float = 120.0,
    max_slope: float = 40.0,
    strict_slope: bool = False,
    flag: str | None = "quality_flag",
    width: float = 100.0,
    low: float = 2200.0,
    high: float = 8800.0,
) -> DataFrame:
    """mean, n, se per elevation band [c-w/2, c+w/2) and key."""
    rows = in_bands(df, cut, max_slope, strict_slope, flag, width, low, high)
    return rows.groupBy("band_center", *keys).agg(
        F.avg("dh").alias("mean"), F.count("*").alias("n"), sample_se("dh").alias("se")
    )


def band_filter(mission: str) -> Column:
    """Which bands count in the area-weighted mean; strictness differs by mission."""
    n, size = F.col("n"), F.abs("mean")
    if mission == "photon":
        return (n >= 10) & (size <= 50) & (size > 0)
    if mission == "laser":
        return ~((n < 20) & (size > 60))
    if mission == "radar":
        return ~((n < 10) & (size > 60))
    raise ValueError(f"unknown mission {mission!r}")


def area_weighted(bands: DataFrame, area: DataFrame, keys: Sequence[str], mission: str) -> DataFrame:
    """Area-weighted mean of the bands, total count and mean(se)/sqrt(bands)."""
    keys = list(keys)
    usable = bands.where(F.col("mean").isNotNull()).where(band_filter(mission))
    joined = usable.join(sized_broadcast(area), ["band_center", "region_id"])
    out = joined.groupBy(*keys).agg(
        F.sum("area").alias("_a"),
        F.sum(F.col("area") * F.col("mean")).alias("_am"),
        F.sum("n").alias("n"),
        (F.avg("se") / F.sqrt(F.count("*"))).alias("se"),
    )
    return out.where(F.col("_a") > 0).select(*keys, (F.col("_am") / F.col("_a")).alias("value"), "n", "se")


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, p: float = 5.0) -> DataFrame:
    """Mean and sd between the p-th and (100-p)-th percentile, midpoint rule."""
    keys = list(keys)
    bounds = settle(
        group_quantiles(df, keys, value, {"_lo": p / 100, "_hi": 1 - p / 100}, kind="midpoint").drop("n")
    )
    inside = attach(df, bounds, keys).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    return inside.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.count("*").alias("n"),
    )


def sigma_filter(df: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Rows within k sample standard deviations of the key's mean.

    The statistics are aggregated and joined back, so a hot key is not sorted
    in one task as a window over it would be.
    """
    keys = list(keys)
    stats = settle(
        df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    )
    return attach(df, stats, keys).where(F.abs(F.col(value) - F.col("_m")) <= k * F.col("_s")).drop("_m", "_s")


def median_filter(df: DataFrame, keys: Sequence[str], value: str, t: float = 75.0) -> DataFrame:
    """Rows closer than t to the key's median."""
    keys = list(keys)
    med = settle(group_quantiles(df, keys, value, {"_med": 0.5}).drop("n"))
    return attach(df, med, keys).where(F.abs(F.col(value) - F.col("_med")) < t).drop("_med")


def qc_height_change(df: DataFrame, max_abs: float = 200.0) -> DataFrame:
    """Rows with |dh| up to ``max_abs``; use :func:`qc_counts` for the report."""
    return df.where(F.abs("dh") <= max_abs)


def qc_counts(df: DataFrame, max_abs: float = 200.0) -> DataFrame:
    """Counts before, after and removed by the height-change cut, in one pass."""
    kept = F.sum((F.abs("dh") <= max_abs).cast("long"))
    return df.agg(
        F.count("*").alias("n_before"),
        kept.alias("n_after"),
        (F.count("*") - kept).alias("n_removed"),
    )


def qc_report(df: DataFrame, max_abs: float = 200.0) -> DataFrame:
    """Key/value report: retained rows and share, dh range, months, ranges."""
    ok = F.abs("dh") <= max_abs

    def of_kept(fn, col):
        return fn(F.when(ok, F.col(col)))

    kept = F.count_if(ok).cast("double")
    facts = df.agg(
        F.count("*").cast("double").alias("n_total"),
        kept.alias("n_kept"),
        (100.0 * kept / F.greatest(F.count("*"), F.lit(1))).alias("kept_percent"),
        *[
            of_kept(fn, col).alias(f"{name}_{end}")
            for col, name in (("lon", "lon"), ("lat", "lat"), ("elev_ref", "elev"))
            for end, fn in (("min", F.min), ("max", F.max))
        ],
    )
    rows = qc_height_change(df, max_abs)
    bounds = percentile_bounds(rows, [], 1.0).select(F.col("low").alias("dh_p01"), F.col("high").alias("dh_p99"))
    months = (
        rows.select((F.year("obs_date") * 12 + F.month("obs_date")).alias("m")).distinct()
        .agg(F.count("*").cast("double").alias("valid_months"))
    )
    out = facts.unpivot([], facts.columns, "item", "value")
    for part in (bounds, months):
        out = out.unionByName(part.unpivot([], part.columns, "item", "value"))
    return out
