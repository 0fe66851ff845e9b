"""Findings of the third round: constant series, ties, exact sums, hot glaciers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glacierlens import session
from glacierlens.functions import regression as reg
from glacierlens.operators import balance as ba
from glacierlens.operators import climate as cl
from glacierlens.operators import ensemble as en
from glacierlens.operators import terrain as te
from glacierlens.plans import catalog
from tests.oracle import TESTDATA

# queries with rows by bin
BY_BIN = (
    "M07g_constant_climate",
    "M04_point_balance_monthly",
    "M04b_point_balance_annual",
    "M04bg_point_balance_annual",
    "M01_climate_on_height",
    "M01g_climate_on_height",
    "M02_yearly_climate",
    "M02g_yearly_climate",
)


def test_a_constant_series_has_deviations_but_no_correlation(spark):
    rows = [(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (3, 1.0, 1.0), (3, None, 7.0)]
    df = spark.createDataFrame(rows, "k int, obs double, sim double")
    got = {r["k"]: (r["md"], r["corr"]) for r in en.deviation_metrics(df, ["k"]).collect()}
    assert (got[1], got[3]) == ((3.5, None), (0.0, None))
    assert got[2][0] == 1.5 and abs(got[2][1] - 1.0) < 1e-12


def test_correlation_of_pairs(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (None, 2.0), (5.0, None)], "score double, smb double")
    assert df.agg(reg.correlation(F.col("score"), F.col("smb"))).first()[0] is None
    full = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 2.0), (None, 90.0), (50.0, None)], "score double, smb double")
    assert abs(full.agg(reg.correlation(F.col("score"), F.col("smb"))).first()[0] - 0.5) < 1e-12


def test_a_month_that_is_a_bound_itself_scores(spark):
    # as sums in another order: each evaluation of the rows gives other last digits
    noise = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    rows = spark.range(81).select(F.lit(1).alias("glacier_id"), F.col("id").alias("m"), (F.col("id") + noise()).alias("anomaly"))
    for _ in range(3):
        dry = {r["m"]: r["score"] for r in cl.score_precipitation(rows).collect()}
        assert dry == {m: 2.0 if m < 1 else 1.0 if m < 5 else 0.5 if m < 9 else 0.0 for m in range(81)}
        hot = {r["m"]: r["score"] for r in cl.score_temperature(rows).collect()}
        assert hot == {m: 4.0 if m > 79 else 2.0 if m > 75 else 1.0 if m > 71 else 0.0 for m in range(81)}


def test_a_total_does_not_depend_on_the_order_of_rows(spark):
    # heights of 2,048 to 4,096 m have steps of 2^-41
    draw = random.Random(3)
    xs = [3000.0 + draw.random() * 400.0 - 2950.0 for _ in range(6400)]
    scale = 1e6 / math.fsum(xs)
    target = spark.createDataFrame([(1, 1e6)], "g int, target double")
    for rows in (xs, sorted(xs), sorted(xs, reverse=True)):
        field = spark.createDataFrame([(1, x) for x in rows], "g int, x double")
        got = te.conserve_total(field, ["g"], "x", target).collect()
        assert sorted(r["x"] for r in got) == sorted(x * scale for x in xs)


def test_every_glacier_of_the_pixels_has_a_target(spark, tmp_path):
    # more glaciers than nations
    spark.range(0, 4000, 50).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.array(F.lit(0.1), F.lit(0.5)).alias("embedding")).write.parquet(
        str(tmp_path / "embeddings.parquet")
    )
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(str(tmp_path / "nation.parquet"))
    out = catalog.queries()["A48_conserve_total"](spark, str(tmp_path))
    totals = {r["glacier_id"]: r["total"] for r in out.groupBy("glacier_id").agg(F.sum("thick").alias("total")).collect()}
    assert sorted(totals) == list(range(40)) and all(abs(totals[g] - 1e6 - g * 1e5) < 1e-3 for g in totals)


def _hot_glacier(spark):
    params = spark.createDataFrame([(1, 100.0, 10.0, 0.0)], "glacier_id long, ref_hgt double, mu double, bias double")
    climate = spark.range(84).select(
        F.lit(1).cast("long").alias("glacier_id"), (1995 + F.floor(F.col("id") / 12)).cast("int").alias("yr"), (F.col("id") % 12 + 1).cast("int").alias("mo"),
        (F.col("id") % 7 - 3).cast("double").alias("temp"), (F.col("id") % 5).cast("double").alias("prcp"),
    )
    bins = spark.range(0, 30000, 1, 1).select(
        (F.floor(F.col("id") / 1000000) + 1).cast("long").alias("glacier_id"), F.col("id").alias("bin_id"), (F.col("id") % 500).cast("double").alias("height"), F.lit(1.0).alias("width")
    )
    return climate, params, bins


def test_points_of_one_glacier_are_dealt_over_tasks(spark):
    points = ba.climate_on_height(*_hot_glacier(spark))
    sizes = [r["count"] for r in points.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 30000 * 84 and max(sizes) < 1.2 * ba.POINTS_A_TASK
    # sums by bin go on without another shuffle of the points
    plan = ba.yearly_climate_on_height(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1


def test_months_beyond_a_broadcast_give_the_same_points(spark, monkeypatch):
    climate, params, bins = _hot_glacier(spark)
    few = bins.where("bin_id < 300")
    want = sorted(map(tuple, ba.climate_on_height(climate, params, few).select("bin_id", "yr", "mo", "temp", "prcp", "melt", "snow").collect()))
    monkeypatch.setattr(ba, "settle", lambda df: session.settle(df, max_rows=0))
    got = ba.climate_on_height(climate, params, few).select("bin_id", "yr", "mo", "temp", "prcp", "melt", "snow").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 300 * 84


def test_bins_of_a_constant_climate_stay_in_their_tasks(spark):
    # a row for each bin of one glacier; A45 reads these rows too
    rows = ba.constant_climate_balance(*_hot_glacier(spark), 1998, 2)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 30000 and max(sizes) <= 30000 / 2


@pytest.mark.parametrize("name", BY_BIN)
def test_rows_of_a_query_by_bin_come_from_many_tasks(spark, monkeypatch, name):
    # 2,000 bins of 25 glaciers, about nine tasks of this size
    monkeypatch.setattr(ba, "POINTS_A_TASK", 20_000, raising=False)
    rows = catalog.queries()[name](spark, f"{TESTDATA}/sf0.01")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(sizes) <= sum(sizes) / 4
