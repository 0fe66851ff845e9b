"""Hand-made tables for the rules that decide correctness."""

import pytest
from pyspark.sql import functions as F

from glacierlens.operators import altimetry as alt
from glacierlens.operators import setops as so
from glacierlens.operators import spatial as sp
from glacierlens.operators import tessellation
from glacierlens.operators import timewindows as tw
from glacierlens.plans.fixtures import Views


def points(spark, values, slope=10.0, quality=0):
    return spark.createDataFrame([("a", float(v), slope, quality) for v in values], "k string, dh double, slope_deg double, quality_flag int")


def test_step_two_on_survivors_or_base(spark):
    # median of the survivors is 90; 130 fails the first cut of 100 but is near the median
    df = points(spark, [80, 90, 95, 130])
    two = alt.robust_stats(df, ["k"], alt.Screen(100, 50, 1, True)).first()
    base = alt.robust_stats(df, ["k"], alt.Screen(100, 50, 1, False)).first()
    assert (two["n"], base["n"]) == (3, 4)


def test_minimum_count_and_single_row(spark):
    few = alt.robust_stats(points(spark, range(10)), ["k"], alt.PHOTON).first()
    assert (few["mean"], few["n"], few["se"]) == (None, 0, None)
    one = alt.robust_stats(points(spark, [5]), ["k"], alt.PHOTON_CELL).first()
    assert (one["mean"], one["n"], one["se"]) == (5.0, 1, 0.0)


def test_slope_strictness(spark):
    df = points(spark, [1, 2], slope=40.0).withColumn("elev_ref", F.lit(3000.0))
    assert alt.robust_stats(df, ["k"], alt.PHOTON_CELL).first()["n"] == 2
    assert alt.band_stats(df, ["k"], strict_slope=True).count() == 0
    assert alt.band_stats(df, ["k"]).first()["band_center"] == 3050


def test_standard_error_counts_all_rows(spark):
    r = alt.band_stats(points(spark, [0, 2, 4]).withColumn("elev_ref", F.lit(2200.0)), ["k"]).first()
    assert r["band_center"] == 2250 and r["se"] == pytest.approx(2 / 3**0.5)


@pytest.mark.parametrize("mission,kept", [("photon", {3}), ("laser", {1, 2, 3}), ("radar", {1, 2, 3, 4})])
def test_band_filters(spark, mission, kept):
    rows = [(1, 5, 10.0), (2, 30, 70.0), (3, 15, 10.0), (4, 15, 70.0), (5, 5, 70.0)]
    df = spark.createDataFrame(rows, "id int, n int, mean double")
    assert {r["id"] for r in df.where(alt.band_filter(mission)).collect()} == kept


def test_windows_are_half_open(spark):
    win = tw.monthly_windows(spark, "2018-01-01", "2018-04-01", "2018-01-01")
    df = spark.createDataFrame([(30,), (31,), (58,), (59,), (200,)], "obs_day int")
    got = {r["obs_day"]: r["win_id"] for r in tw.window_join(df, win, "2018-01-01").collect()}
    assert got == {30: 201801, 31: 201802, 58: 201802, 59: 201803}


def test_season_and_campaign_windows(spark):
    s = tw.seasonal_windows(spark, "2018-01-01", "2019-01-01", "2018-01-01")
    assert s.count() == 10 and s.agg(F.max("end_day")).first()[0] == 365
    c = tw.campaign_windows(spark, "2000-01-01").orderBy("win_id").collect()
    assert len(c) == 19 and c[0]["start_day"] == 1146 and c[0]["end_day"] == 1184


def square(i, x0, y0, size):
    ring = [(0, 0), (size, 0), (size, size), (0, size), (0, 0)]
    return [("h", i, 0, k, float(x0 + a), float(y0 + b)) for k, (a, b) in enumerate(ring)]


POLY = "hier string, id long, ring int, vertex int, x double, y double"


def test_highest_id_wins_and_edges_count(spark):
    poly = spark.createDataFrame(square(3, 0, 0, 4) + square(5, 2, 2, 4), POLY)
    pts = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (0.0, 2.0), (4.0, 1.0), (9.0, 9.0), (6.0, 6.0), (-0.1, 2.0)], "lon double, lat double")
    got = {(r["lon"], r["lat"]): r["h"] for r in sp.tag_regions(pts, poly, ["h"]).collect()}
    assert got == {(1.0, 1.0): 3, (3.0, 3.0): 5, (0.0, 2.0): 3, (4.0, 1.0): 3, (9.0, 9.0): 0, (6.0, 6.0): 5, (-0.1, 2.0): 0}


def test_hole_and_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(tessellation, "LEAF_EDGES", 8)
    outer, hole = square(1, 0, 0, 10), [(h, i, 1, k, x, y) for h, i, _, k, x, y in square(1, 4, 4, 2)]
    many = [r for i in range(2, 9) for r in square(i, 0, 0, 3)]
    poly = spark.createDataFrame(outer + hole + many, POLY)
    pts = spark.createDataFrame([(1.5, 1.5), (5.0, 5.0), (8.0, 8.0)], "lon double, lat double")
    got = {r["lon"]: sorted(h["id"] for h in r["_in"]) for r in sp.containing(pts, poly).collect()}
    assert got == {1.5: list(range(1, 9)), 5.0: [], 8.0: [1]}


def test_hot_cell_join_without_broadcast(spark, monkeypatch):
    v = Views(spark, "/root/testdata/sf0.001")
    pts = v.fp.select("track", "lon", "lat")
    want = sp.tag_regions(pts, v.hpoly, ["r22"]).groupBy("r22").count().collect()
    monkeypatch.setattr(sp, "BROADCAST_EDGES", 0)
    got = sp.tag_regions(pts, v.hpoly, ["r22"]).groupBy("r22").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_nearest_point_far_away_and_ties(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0), (2, 2.0, 0.0), (3, 100.0, 50.0), (0, 2.0, 0.0)], "idx int, lon double, lat double")
    t = spark.createDataFrame([(1, 1.0, 0.0), (2, 60.0, 20.0), (3, -150.0, -60.0)], "g int, cen_lon double, cen_lat double")
    got = {r["g"]: r["idx"] for r in sp.nearest_grid_point(t, grid, "g").collect()}
    assert got == {1: 0, 2: 3, 3: 1}


def test_mission_merge_order(spark):
    def m(*days):
        return spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("obs_date"))

    out = so.merge_missions(m("2004-01-01"), m("2018-12-31", "2019-01-01"), m("2018-12-31", "2019-01-01"))
    assert [str(r[0]) for r in out.collect()] == ["2004-01-01", "2018-12-31", "2019-01-01"]


def test_strict_id_intersection(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,)], "id int")
    assert [r[0] for r in so.id_intersection(a, b, "id").collect()] == [2]
    with pytest.raises(Exception, match="without a counterpart"):
        so.id_intersection(a, b, "id", strict=True).collect()
