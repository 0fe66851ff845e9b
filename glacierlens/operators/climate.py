"""Climate aggregation and extreme scores per glacier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.quantiles import group_quantiles
from glacierlens.functions.scalars import clip

# fixed values: score weights, tightest threshold first
TEMP_WEIGHTS = ((99, 4.0), (95, 2.0), (90, 1.0))
PRCP_WEIGHTS = ((1, 2.0), (5, 1.0), (10, 0.5))
FUTURE_PRCP_WEIGHTS = ((1, 4.0), (5, 2.0), (10, 1.0))

# named aggregates a caller can choose by name
AGGS = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def daily_to_monthly(df: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """Monthly mean of the non-missing days; months without any are NULL (n = 0).

    Unknown variable names in ``variables`` are skipped.
    """
    rows = df.where(F.col("variable").isin(list(variables))) if variables else df
    value = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    return rows.groupBy("glacier_id", "variable", F.trunc("obs_date", "month").alias("month")).agg(
        F.avg(value).alias("value"), F.count(value).alias("n_days")
    )


def empty_months(monthly: DataFrame) -> DataFrame:
    """The log of all-missing months."""
    return monthly.where(F.col("n_days") == 0).select("glacier_id", "variable", "month")


def anomalies(df: DataFrame, value: str, out: str = "anomaly") -> DataFrame:
    """Value minus the glacier's mean over all months.

    A glacier's series is unique per month, so the window holds one row per
    month of the record at most.
    """
    return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy("glacier_id")))


def glacier_quantiles(df: DataFrame, value: str, percents: Sequence[float], prefix: str = "p") -> DataFrame:
    """Linear percentiles per glacier over its monthly series."""
    arr = F.percentile(value, F.array(*[F.lit(p / 100) for p in percents]))
    q = df.groupBy("glacier_id").agg(arr.alias("_q"))
    return q.select("glacier_id", *[F.col("_q")[i].alias(f"{prefix}{p}") for i, p in enumerate(percents)])


def step_score(value: Column, weights, hot: bool, prefix: str) -> Column:
    """Stepwise score, tightest threshold first, NULL scores 0."""
    out = None
    for p, w in weights:
        bound = F.col(f"{prefix}{p}")
        test = value >= bound if hot else value <= bound
        out = F.when(test, F.lit(w)) if out is None else out.when(test, F.lit(w))
    return out.otherwise(F.lit(0.0))


def _scored(df, value, weights, hot):
    """Scores by percentiles of the glacier's own series, which holds a row per month.

    A bound may be one of the values itself.  Values and bounds come from one evaluation of the
    rows, as sums made twice may add up in another order and differ in the last digit.
    """
    bounds = F.percentile(value, F.array(*[F.lit(p / 100) for p, _ in weights]))
    rows = df.where(F.col("glacier_id").isNotNull()).withColumn("_q", bounds.over(Window.partitionBy("glacier_id")))
    rows = rows.withColumns({f"_p{p}": F.col("_q")[i] for i, (p, _) in enumerate(weights)})
    return rows.withColumn("score", step_score(F.col(value), weights, hot, "_p")).drop(
        "_q", *[f"_p{p}" for p, _ in weights]
    )


def score_temperature(df: DataFrame, value: str = "anomaly") -> DataFrame:
    return _scored(df, value, TEMP_WEIGHTS, True)


def score_precipitation(df: DataFrame, value: str = "anomaly") -> DataFrame:
    return _scored(df, value, PRCP_WEIGHTS, False)


def annual_scores(df: DataFrame) -> DataFrame:
    return df.groupBy("glacier_id", "yr").agg(F.sum("score").alias("score"))


def compound_scores(temp: DataFrame, prcp: DataFrame) -> DataFrame:
    """Sum of both year scores; NULL if either is absent."""
    t = temp.withColumnRenamed("score", "temp_score")
    p = prcp.withColumnRenamed("score", "prcp_score")
    return t.join(p, ["glacier_id", "yr"], "full").withColumn(
        "score", F.col("temp_score") + F.col("prcp_score")
    )


def period_filter(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Start inclusive, end exclusive, either may be missing."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) < F.lit(end).cast("date"))
    return df


def period_difference(
    df: DataFrame, value: str, early: tuple[int, int], recent: tuple[int, int], factor: float = 1.0
) -> DataFrame:
    """Per-glacier mean of two inclusive year ranges and their difference."""

    def mean(span):
        return F.avg(F.when(F.col("yr").between(*span), F.col(value))) * F.lit(factor)

    return df.groupBy("glacier_id").agg(mean(early).alias("early"), mean(recent).alias("recent")).withColumn(
        "difference", F.col("recent") - F.col("early")
    )


def attach_series(glaciers: DataFrame, values: DataFrame, key: str = "glacier_id") -> DataFrame:
    """All glaciers with their values; those without stay with NULL."""
    return glaciers.join(values, key, "left")


def grid_aggregate(df: DataFrame, value: str, size: float = 1.0, agg: str = "mean") -> DataFrame:
    """Per cell: total area, aggregate of the value, glacier count, cell centre."""
    cx, cy = F.floor(F.col("cen_lon") / size) * size, F.floor(F.col("cen_lat") / size) * size
    return df.groupBy(cx.cast("double").alias("cell_lon"), cy.cast("double").alias("cell_lat")).agg(
        F.sum("area_km2").alias("area_km2"),
        AGGS[agg](value).alias("value"),
        F.count("*").alias("n_glaciers"),
    ).withColumn("center_lon", F.col("cell_lon") + size / 2).withColumn(
        "center_lat", F.col("cell_lat") + size / 2
    )


def yearly_distribution(df: DataFrame, value: str, year: str = "yr") -> DataFrame:
    """Mean, median and box quartiles per year over all glaciers."""
    q = group_quantiles(df, [year], value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    m = df.groupBy(year).agg(F.avg(value).alias("mean"))
    return m.join(q, year)


def annual_pdd(df: DataFrame) -> DataFrame:
    """Sum of positive monthly temperatures and of precipitation per year."""
    return df.groupBy("glacier_id", "yr").agg(
        F.sum(F.when(F.col("temp") > 0, F.col("temp")).otherwise(0.0)).alias("pdd"),
        F.sum("prcp").alias("prcp"),
    )


def top_n_years(scores: DataFrame, n: int = 5) -> DataFrame:
    """Highest n years per glacier, ties to the earliest; short series skipped."""
    per = Window.partitionBy("glacier_id")
    ranked = scores.where(F.col("score").isNotNull()).withColumn(
        "rank", F.row_number().over(per.orderBy(F.desc("score"), "yr"))
    ).withColumn("_n", F.count("*").over(per))
    return ranked.where((F.col("_n") >= n) & (F.col("rank") <= n)).drop("_n")


def period_share(top: DataFrame, start: int, length: int = 5) -> DataFrame:
    """Share of the selected glacier-years falling into each period of years."""
    period = (F.floor((F.col("yr") - start) / length) * length + start).cast("int")
    counts = top.groupBy(period.alias("period_start")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("period_start", "n", (F.col("n") / total).alias("share"))


def winter_daily_prcp(df: DataFrame, y0: int, y1: int, southern: bool = False) -> DataFrame:
    """Mean daily winter precipitation; NULL unless every winter month is there."""
    months = [4, 5, 6, 7, 8, 9, 10] if southern else [10, 11, 12, 1, 2, 3, 4]
    days = F.day(F.last_day(F.make_date("yr", "mo", F.lit(1))))
    w = df.where(F.col("yr").between(y0, y1) & F.col("mo").isin(months))
    full = F.count("prcp") == (y1 - y0 + 1) * len(months)
    return w.groupBy("glacier_id").agg(
        F.when(full, F.avg(F.col("prcp") / days)).alias("winter_prcp"), F.count("prcp").alias("n_months")
    )


# fixed values: winter precipitation factor a*ln(w)+b and its range
WINTER_FACTOR = (-1.0614, 3.92, 0.1, 10.0)


def winter_prcp_factor(w: Column, params=WINTER_FACTOR) -> Column:
    a, b, lo, hi = params
    # the logarithm of nothing is minus infinity, NULL stays NULL
    f = F.when(w > 0, F.lit(a) * F.ln(w) + F.lit(b)).when(w == 0, F.lit(hi))
    return clip(f, lo, hi)
