"""Calendar window tables and the window join.

All windows are half-open ``[start_day, end_day)`` in days from a reference
date.  A window table has one row per window; its length follows from the
calendar, not from the data.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glacierlens.functions.scalars import mid_day, month_index
from glacierlens.session import sized_broadcast

# fixed values: first and last day of the 19 laser campaigns
CAMPAIGNS = (
    ("2003-02-20", "2003-03-29"), ("2003-09-25", "2003-11-19"), ("2004-02-17", "2004-03-21"),
    ("2004-05-18", "2004-06-21"), ("2004-10-03", "2004-11-08"), ("2005-02-17", "2005-03-24"),
    ("2005-05-20", "2005-06-23"), ("2005-10-21", "2005-11-24"), ("2006-02-22", "2006-03-28"),
    ("2006-05-24", "2006-06-26"), ("2006-10-25", "2006-11-27"), ("2007-03-12", "2007-04-14"),
    ("2007-05-15", "2007-09-11"), ("2007-10-02", "2007-11-05"), ("2008-02-17", "2008-03-21"),
    ("2008-10-04", "2008-10-19"), ("2008-11-25", "2008-12-17"), ("2009-03-09", "2009-04-11"),
    ("2009-09-30", "2009-10-11"),
)


def _months(start: str, end: str) -> int:
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    return (b.year - a.year) * 12 + b.month - a.month


def _finish(df: DataFrame, kind: str, ref: str, label: Column) -> DataFrame:
    ref_date = F.lit(ref).cast("date")
    return df.select(
        F.lit(kind).alias("win_kind"),
        label.cast("int").alias("win_id"),
        F.date_diff("start_date", ref_date).alias("start_day"),
        F.date_diff("end_date", ref_date).alias("end_day"),
    ).withColumn("mid_day", mid_day("start_day", "end_day"))


def month_windows(
    spark: SparkSession,
    start: str,
    end: str,
    ref: str,
    kind: str,
    length: int = 1,
    step: int = 1,
    shift: int = 0,
    label: str = "yearmonth",
    inside: bool = True,
) -> DataFrame:
    """Windows of ``length`` months every ``step`` months between two dates.

    ``shift`` moves the start (centred windows); with ``inside`` the last
    window ends at or before ``end``, else the last one starts before it.
    """
    span = _months(start, end)
    n = (span - length) // step + 1 if inside else -(-span // step)
    base = spark.range(max(n, 0)).select(
        F.add_months(F.lit(start).cast("date"), (F.col("id") * step).cast("int")).alias("anchor")
    )
    wins = base.select(
        "anchor",
        F.add_months("anchor", F.lit(shift)).alias("start_date"),
        F.add_months("anchor", F.lit(shift + length)).alias("end_date"),
    )
    name = F.year("anchor") if label == "year" else F.year("anchor") * 100 + F.month("anchor")
    return _finish(wins, kind, ref, name)


def monthly_windows(spark, start, end, ref) -> DataFrame:
    return month_windows(spark, start, end, ref, "month")


def seasonal_windows(spark, start, end, ref) -> DataFrame:
    """Three months, sliding by one, the last one starting three months before the end."""
    return month_windows(spark, start, end, ref, "season", length=3)


def annual_windows(spark, start, end, ref) -> DataFrame:
    """One-, two- and three-year windows and the whole record in one table."""
    whole = _months(start, end)
    parts = [
        month_windows(spark, start, end, ref, kind, length=n, step=12, label="year")
        for kind, n in (("y1", 12), ("y2", 24), ("y3", 36), ("all", whole))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centred_windows(spark, start, end, ref) -> DataFrame:
    """[y-1, y+2) per year."""
    return month_windows(spark, start, end, ref, "centred3", length=36, step=12, shift=-12, label="year", inside=False)


def overlap_windows(spark, start, end, ref) -> DataFrame:
    """[y-01-01, (y+1)-10-01), 21 months each year."""
    return month_windows(spark, start, end, ref, "overlap21", length=21, step=12, label="year", inside=False)


def campaign_windows(spark, ref, campaigns=CAMPAIGNS, shift_months: int = 0) -> DataFrame:
    """Irregular campaigns, first day to last day inclusive."""
    rows = [(i + 1, a, b) for i, (a, b) in enumerate(campaigns)]
    df = spark.createDataFrame(rows, "win_id int, a string, b string").select(
        "win_id",
        F.add_months(F.col("a").cast("date"), F.lit(shift_months)).alias("start_date"),
        F.date_add(F.add_months(F.col("b").cast("date"), F.lit(shift_months)), 1).alias("end_date"),
    )
    return _finish(df, "campaign", ref, F.col("win_id"))


def window_join(points: DataFrame, win: DataFrame, ref: str, day: str = "obs_day") -> DataFrame:
    """Each point to every window it lies in, as an equi-join on calendar month.

    Windows are exploded to the months they touch, so a point only meets the
    windows of its month; the day test removes the rest.
    """
    ref_date = F.lit(ref).cast("date")
    months = F.sequence(
        month_index(F.date_add(ref_date, F.col("start_day"))),
        month_index(F.date_add(ref_date, F.col("end_day") - 1)),
    )
    by_month = sized_broadcast(win.withColumn("_m", F.explode(months)))
    tagged = points.withColumn("_m", month_index(F.date_add(ref_date, F.col(day))))
    hit = (F.col(day) >= F.col("start_day")) & (F.col(day) < F.col("end_day"))
    return tagged.join(by_month, "_m").where(hit).drop("_m")


def month_join(parts: DataFrame, win: DataFrame, ref: str, month: str = "month") -> DataFrame:
    """Partial aggregates of calendar months to every window that holds the month.

    For windows that begin and end with a month; others need the days of their rows.
    """
    ref_date = F.lit(ref).cast("date")
    first, end = F.date_add(ref_date, F.col("start_day")), F.date_add(ref_date, F.col("end_day"))
    if not win.where((F.dayofmonth(first) != 1) | (F.dayofmonth(end) != 1)).isEmpty():
        raise ValueError("windows must begin and end with a month")
    months = F.sequence(month_index(first), month_index(F.date_sub(end, 1)))
    return parts.join(sized_broadcast(win.withColumn(month, F.explode(months))), month)


def with_month(points: DataFrame, ref: str, day: str = "obs_day", month: str = "month") -> DataFrame:
    """Points with the number of their calendar month."""
    return points.withColumn(month, month_index(F.date_add(F.lit(ref).cast("date"), F.col(day))))
