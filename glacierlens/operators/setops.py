"""Unions, intersections, differences and ordered output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_missions(laser: DataFrame, radar: DataFrame, photon: DataFrame, switch: str = "2019-01-01", date: str = "obs_date") -> DataFrame:
    """Mission 1, mission 2 before the switch date, mission 3 from it on, by date."""
    day = F.lit(switch).cast("date")
    return laser.unionByName(radar.where(F.col(date) < day)).unionByName(
        photon.where(F.col(date) >= day)
    ).orderBy(date)


def union_regions(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def id_intersection(left: DataFrame, right: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Ids of both sides; ``strict`` fails on the first id of the left that the right lacks."""
    if not strict:
        return left.select(key).intersect(right.select(key))
    marked = left.select(key).distinct().join(right.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    checked = F.when(F.col("_r"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("id without a counterpart: "), F.col(key).cast("string")))
    )
    return marked.select(checked.alias(key))


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def first_rows(df: DataFrame, order: Sequence[str], n: int, skip: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
