"""Missing values stay missing, fits keep their digits, hot keys are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glacierlens import session
from glacierlens.functions import quantiles as qn
from glacierlens.functions import regression as reg
from glacierlens.operators import altimetry as alt
from glacierlens.operators import balance as ba
from glacierlens.operators import climate as cl
from glacierlens.operators import scenario as sc
from glacierlens.operators import series as se


def months(spark, temp, prcp, gcm=False):
    rows = [(1, *(("m", "s") if gcm else ()), 2000 + i // 12, i % 12 + 1, t, p) for i, (t, p) in enumerate(zip(temp, prcp, strict=True))]
    names = "glacier_id long, " + ("gcm string, ssp string, " if gcm else "") + "yr int, mo int, temp double, prcp double"
    return spark.createDataFrame(rows, names)


def test_a_missing_month_leaves_no_annual_balance(spark):
    params = spark.createDataFrame([(1, 100.0, 10.0, 0.0)], "glacier_id long, ref_hgt double, mu double, bias double")
    bins = spark.createDataFrame([(1, 0, 100.0, 1.0)], "glacier_id long, bin_id int, height double, width double")
    temp = [5.0] * 24
    temp[6] = None
    clim = months(spark, temp, [10.0] * 24)
    assert [r["yr"] for r in ba.specific_mb(clim, params, bins).collect()] == [2001]
    points = ba.climate_on_height(clim, params, bins)
    assert {r["mo"] for r in points.where("melt is null and snow is null").collect()} == {7}
    assert [r["yr"] for r in ba.point_balance(points, annual=True).collect()] == [2001]
    assert [r["yr"] for r in ba.yearly_climate_on_height(points, flatten=True).collect()] == [2001]


def test_linear_balance_without_an_ela(spark):
    bins = spark.createDataFrame([(1, 100.0), (2, 9000.0)], "glacier_id long, height double")
    ela = spark.createDataFrame([(1, None), (2, 100.0)], "glacier_id long, ela double")
    assert [r["mb"] for r in ba.linear_balance(bins, ela, max_mb=10.0).orderBy("glacier_id").collect()] == [None, 10.0]


def test_climate_qc_needs_whole_years(spark):
    params = spark.createDataFrame([(1, 100.0, 10.0, 0.0)], "glacier_id long, ref_hgt double, mu double, bias double")
    bins = spark.createDataFrame([(1, 0, 100.0, 1.0)], "glacier_id long, bin_id int, height double, width double")
    temp = [float(t) for t in range(-6, 6)] * 2
    whole = ba.climate_qc(months(spark, temp[:12], [1.0] * 12), params, bins, 2).first()
    temp[23] = temp[22] = None
    assert ba.climate_qc(months(spark, temp, [1.0] * 24), params, bins, 2).first() == whole


def test_winter_factor(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,)], "w double")
    assert [r[0] for r in df.select(cl.winter_prcp_factor(F.col("w"))).collect()] == [None, 10.0, 3.92]


def test_snow_bucket_after_a_gap(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 1.0), (1, 2, 1.0, 9.0), (1, 3, 4.0, None), (1, 4, 1.0, 0.0)], "k int, t int, snow double, melt double")
    got = [(r["bucket"], r["melt_limited"]) for r in se.snow_bucket(df, ["k"], ["t"], "snow", "melt").orderBy("t").collect()]
    assert got == [(4.0, 1.0), (0.0, 5.0), (None, None), (None, None)]


@pytest.mark.parametrize("method", ["delta", "qdm", "mean"])
def test_missing_precipitation(spark, method):
    ref = months(spark, [1.0 * i for i in range(24)], [10.0 + i for i in range(24)])
    prcp = [5.0 + i for i in range(24)]
    prcp[3] = None
    model = months(spark, [2.0 * i for i in range(24)], prcp, gcm=True)
    if method == "delta":
        got = sc.delta_method(model, ref, 2000, 2001)
    elif method == "qdm":
        got = sc.qdm(ref, model, model)
    else:
        anomalies = spark.createDataFrame([(1, 2000, 1.0, None), (1, 2001, 1.0, 2.0)], "glacier_id long, yr int, temp double, prcp double")
        got = sc.ensemble_mean_member(anomalies, ref, 2000, 2001)
        assert {r["yr"] for r in got.where("prcp is null").collect()} == {2000}
        return
    assert [(r["yr"], r["mo"]) for r in got.where("prcp is null").collect()] == [(2000, 4)]


def test_scaling_of_nothing_by_nothing_is_unknown(spark):
    obs, model = months(spark, [1.0] * 12, [1.0] * 12), months(spark, [1.0] * 12, [1.0] * 12, gcm=True)
    matched = spark.createDataFrame([(1, "m", "s", 2050, 2000)], "glacier_id long, gcm string, ssp string, yr int, hist_yr int")
    assert sc.year_scaling(obs, model, matched, "temp", True).first()["scaling"] is None
    warm = months(spark, [0.0] * 6 + [2.0] * 6, [1.0] * 12)
    assert sc.year_scaling(warm, model, matched, "temp", True).first()["scaling"] == 2.0


def test_cubic_on_day_numbers(spark):
    x = np.linspace(20_000, 20_200, 500)
    y = 3.0 + 0.5 * (x - 20_100) - 2e-3 * (x - 20_100) ** 2 + 1e-6 * (x - 20_100) ** 3
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0), (None, 2.0, 2.0), (None, 3.0, 1.0), (None, 4.0, 5.0)], "k string, x double, y double")
    fits = {r["k"]: r for r in reg.poly_fit(df, ["k"], "x", "y", 3).collect()}
    r = fits["a"]
    assert r["c3"] == pytest.approx(1e-6, rel=1e-6)
    assert r["c2"] + 3 * r["c3"] * (20_100 - r["x0"]) == pytest.approx(-2e-3, rel=1e-6)
    assert None in fits


def test_tiny_values_take_no_more_passes(spark, monkeypatch):
    monkeypatch.setattr(qn, "CANDIDATES", 50)
    rng = np.random.default_rng(1)
    passes = {}
    inner = qn.settle_with_peak
    for scale in (1e-9, 1e3):
        calls = []
        monkeypatch.setattr(qn, "settle_with_peak", lambda *a, calls=calls: calls.append(1) or inner(*a))
        v = rng.random(4000) * scale
        got = qn.group_quantiles(spark.createDataFrame([(float(x),) for x in v], "v double"), [], "v", {"m": 0.5}).first()["m"]
        assert got == pytest.approx(np.median(v), rel=1e-12)
        passes[scale] = len(calls)
    assert passes[1e-9] <= passes[1e3] + 1 <= 4


def test_one_key_with_all_rows_is_dealt_out(spark, monkeypatch):
    df = spark.range(20_000).select(
        F.lit("hot").alias("k"), (F.sin(F.col("id")) * 60).alias("dh"), F.lit(1.0).alias("slope_deg"), F.lit(0).alias("quality_flag")
    ).union(spark.createDataFrame([("cold", 1.0, 1.0, 0)], "k string, dh double, slope_deg double, quality_flag int"))
    want = sorted(map(tuple, alt.robust_stats(df, ["k"], alt.LASER).collect()))
    # no table fits a broadcast, and no partition is merged with others
    real = session.settle_with_peak
    for module in (session, qn):
        monkeypatch.setattr(module, "settle_with_peak", lambda table, column, max_rows=0: real(table, column, 0))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, alt.robust_stats(df, ["k"], alt.LASER).collect()))
        kept, _ = alt.screened(df, ["k"], alt.LASER)
        most = kept.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:] == pytest.approx(w[1:])
    assert most[0] < 0.6 * most[1]
