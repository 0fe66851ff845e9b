"""Bias correction, balance, robust fits and decomposition: invariants and loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glacierlens.functions import regression as reg
from glacierlens.functions import scalars as sc
from glacierlens.functions.decompose import stl
from tests.plain_lines import bisquare_line, huber_line
from glacierlens.operators import balance as mb
from glacierlens.operators import ensemble as en
from glacierlens.operators import scenario as sn
from glacierlens.operators import series as se
from glacierlens.operators import terrain as te
from glacierlens.operators import trends as tr
from glacierlens.plans.fixtures import Views

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def monthly(years, seed=0):
    rng = np.random.default_rng(seed)
    yr, mo = np.repeat(years, 12), np.tile(np.arange(1, 13), len(years))
    t = 10 * np.sin(mo / 12 * 6.28) + 0.05 * (yr - yr[0]) + rng.normal(0, 1, len(yr))
    return pd.DataFrame({"glacier_id": 1, "yr": yr, "mo": mo, "temp": t, "prcp": rng.gamma(2, 20, len(yr))})


def test_delta_method_keeps_reference_climate(spark):
    ref = spark.createDataFrame(monthly(range(1990, 2000), 1))
    gcm = spark.createDataFrame(monthly(range(1980, 2010), 2).assign(gcm="g", ssp="s"))
    out = sn.delta_method(gcm, ref, 1990, 1999, scale_std=False).where(F.col("yr").between(1990, 1999))
    want = ref.groupBy("mo").agg(F.avg("temp").alias("t"), F.avg("prcp").alias("p"))
    both = out.groupBy("mo").agg(F.avg("temp").alias("a"), F.avg("prcp").alias("b")).join(want, "mo").toPandas()
    assert np.allclose(both.a, both.t) and np.allclose(both.b, both.p)


def test_qdm_follows_numpy_quantiles(spark):
    obs, mod = monthly(range(1990, 2010), 1), monthly(range(1990, 2010), 2).assign(gcm="g", ssp="s")
    out = sn.qdm(spark.createDataFrame(obs), spark.createDataFrame(mod), spark.createDataFrame(mod), max_ratio=1e9).toPandas()
    for m in (1, 7):
        o = np.sort(obs[obs.mo == m].temp)
        got = np.sort(out[out.mo == m].temp)
        x = np.sort(mod[mod.mo == m].temp)
        tau = np.arange(1, 21) / 20
        assert np.allclose(got, np.sort(np.quantile(o, tau) + x - np.quantile(x, tau)))


def test_qdm_fallback_chain(spark):
    base = pd.DataFrame({"glacier_id": [1], "mo": [1], "temp": [0.0]})
    obs = pd.concat([base.assign(yr=y, prcp=p) for y, p in zip(range(4), (1.0, 2, 3, 4))])
    hist = pd.concat([base.assign(yr=y, prcp=0.0) for y in range(4)] + [base.assign(yr=y, prcp=8.0, mo=2) for y in range(5)]).assign(gcm="g", ssp="s")
    fut = pd.concat([base.assign(yr=y, prcp=p) for y, p in zip((10, 11), (4.0, 6.0))]).assign(gcm="g", ssp="s")
    obs = pd.concat([obs, obs.assign(mo=2)])
    out = sn.qdm(*[spark.createDataFrame(x) for x in (obs, hist, fut)]).toPandas().set_index("yr")
    # month 1 has no usable ratio, so the all-month medians 5 / 8 apply
    assert out.loc[11, "prcp"] == pytest.approx(4.0 * 5 / 8)


def test_smb_telescopes_to_dh(spark):
    runs = pd.DataFrame({"rgi_id": 1, "yr": range(2000, 2010), "volume": np.linspace(50, 30, 10), "area": 5.0})
    dh = en.cumulative_dh(en.specific_balance(spark.createDataFrame(runs), ["rgi_id"]), ["rgi_id"]).orderBy("yr").toPandas()
    assert dh.dh.iloc[-1] == pytest.approx((30 - 50) / 5.0)


def test_smb_falls_back_where_the_area_is_gone(spark):
    runs = spark.createDataFrame([(1, 2000, 10.0, 2.0), (1, 2001, 0.0, 0.0), (1, 2002, 0.0, 0.0)], "rgi_id int, yr int, volume double, area double")
    smb = [r["smb"] for r in en.specific_balance(runs, ["rgi_id"]).orderBy("yr").collect()]
    assert smb == [pytest.approx(-4.5), None]


def test_snow_bucket_equals_the_loop(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": 1, "t": range(200), "snow": rng.gamma(1, 2, 200), "melt": rng.gamma(1, 2.2, 200)})
    got = se.snow_bucket(spark.createDataFrame(pdf), ["k"], ["t"], "snow", "melt").orderBy("t").toPandas()
    b, want, melts = 0.0, [], []
    for s, m in zip(pdf["snow"], pdf["melt"]):
        melts.append(min(m, b + s))
        b = max(b + s - m, 0)
        want.append(b)
    assert np.allclose(got.bucket, want) and np.allclose(got.melt_limited, melts)


def test_hypsometry_sums_to_1000(v):
    px = v.px.select(F.floor(F.col("r") / 37).cast("int").alias("glacier_id"), "r", "c", (3000 + F.col("value") * 700).alias("value"))
    totals = te.hypsometry(px).groupBy("glacier_id").agg(F.sum("permille").alias("s")).collect()
    assert {r["s"] for r in totals} == {1000}


def test_conserve_total(v, spark):
    px = v.px.select(F.lit(1).alias("g"), F.abs("value").alias("x"))
    out = te.conserve_total(px, ["g"], "x", spark.createDataFrame([(1, 123.0)], "g int, target double"), cell=2.0)
    assert out.agg(F.sum("x") * 2).first()[0] == pytest.approx(123.0)


def test_hampel_over_a_gap(spark):
    """A window of missing values alone has no median and no outlier."""
    rows = [(1, t, None if 3 <= t <= 20 else float(t)) for t in range(30)]
    out = se.hampel(spark.createDataFrame(rows, "k int, t int, v double"), ["k"], "t", "v").orderBy("t").collect()
    assert [r.filtered for r in out] == [r[2] for r in rows] and out[12].is_outlier is None


def test_robust_lines_ignore_outliers():
    x = np.arange(60.0)
    y = 2.0 + 0.5 * x + np.random.default_rng(1).normal(0, 0.2, 60)
    y[::10] += 40
    for fit in (bisquare_line, huber_line):
        slope, icept, p, half = fit(x, y)
        assert slope == pytest.approx(0.5, abs=0.05) and p < 1e-6 and half > 0
    assert bisquare_line(x, y)[1] == pytest.approx(2.0, abs=0.3)


@pytest.mark.parametrize("kind", ["bisquare", "huber"])
def test_folds_are_the_plain_loops(spark, kind):
    """Series with outliers, of equal values, on a line, with a step, with equal x."""
    rng = np.random.default_rng(8)
    x = np.arange(40.0) * 30
    series = {
        "noise": (x, rng.normal(0, 3, 40)), "outliers": (x, 2 + 0.01 * x + rng.normal(0, 0.2, 40) + 50 * (np.arange(40) % 9 == 0)), "flat": (x, np.full(40, 2.5)),
        "line": (x, 1 + 0.5 * x), "step": (x, np.where(x < 300, 0.0, 9.0)), "upright": (np.full(12, 3.0), rng.normal(0, 1, 12)),
        "large": (x + 1e6, rng.normal(1e5, 1, 40)), "short": (x[:9], x[:9]), "ten": (x[:10], rng.standard_cauchy(10)),
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "x": a, "y": b, "n": 30}) for k, (a, b) in series.items()])
    df = spark.createDataFrame(pdf)
    if kind == "bisquare":
        rows, plain = tr.robust_trend_bisquare(df, ["k"], "x", "y"), bisquare_line
    else:
        rows, plain = tr.robust_trend_huber(df, ["k"], "x", "y"), huber_line
        clean = se.hampel(df.where("y <> 0"), ["k"], "x", "y").toPandas()
        series = {k: tuple(g.sort_values("x")[["x", "filtered"]].to_numpy(float).T) for k, g in clean.groupby("k") if k != "upright"}
    got = {r["k"]: r for r in rows.collect()}
    for k, (a, b) in series.items():
        want = plain(a, b) if len(a) >= 10 else None
        have = got[k]["slope"], got[k]["intercept"], got[k]["p"], got[k]["half_ci"]
        assert have == (None,) * 4 if want is None else have == pytest.approx(want, rel=1e-6, abs=1e-9), k


def test_bisquare_trend_needs_ten_points(spark):
    pdf = pd.DataFrame({"k": ["a"] * 9 + ["b"] * 12, "x": list(range(9)) + list(range(12)), "y": np.arange(21.0) * 3})
    got = {r["k"]: r["slope"] for r in tr.robust_trend_bisquare(spark.createDataFrame(pdf), ["k"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(3.0)


def test_huber_trend_masks_rare_and_zero(spark):
    pdf = pd.DataFrame({"k": "a", "x": np.arange(14.0), "y": np.arange(14.0) * 2 + 1, "n": 30})
    pdf.loc[3, "n"], pdf.loc[5, "y"] = 5, 0.0
    row = tr.robust_trend_huber(spark.createDataFrame(pdf), ["k"], "x", "y").first()
    assert row["n"] == 12 and row["slope"] == pytest.approx(2.0)


def test_stl_splits_a_known_series():
    t = np.arange(240)
    season = 5 * np.sin(2 * np.pi * t / 12)
    y = 0.02 * t + season
    trend, seas, _ = stl(y, 12, 13, 241)
    assert np.abs(trend - 0.02 * t).max() < 0.05 and np.abs(seas - season).max() < 0.05
    y[100] += 50
    rt, rs, w = stl(y, 12, 13, 25, robust=True)
    assert w[100] < 0.01 and np.abs(rt - 0.02 * t).max() < 0.2


def test_seasonal_trend_adds_up(spark):
    out = tr.seasonal_trend(spark.createDataFrame(monthly(range(2000, 2006))), ["glacier_id"], ["yr", "mo"], ["temp"]).toPandas()
    assert np.allclose(out.temp, out.temp_trend + out.temp_seasonal + out.temp_resid)


def test_detrended_qm_restores_the_observed_residuals(spark):
    obs = tr.seasonal_trend(spark.createDataFrame(monthly(range(1990, 2010), 4)), ["glacier_id"], ["yr", "mo"], ["temp", "prcp"])
    fut = obs.withColumn("gcm", F.lit("g")).withColumn("ssp", F.lit("s"))
    out = sn.detrended_qm(obs, fut).join(obs, ["glacier_id", "yr", "mo"]).select((sn.F.col("prcp_trend")).alias("t"), "mo").count()
    assert out == 240
    got = sn.detrended_qm(obs, fut).agg(F.min("prcp"), F.count("temp")).first()
    assert got[0] >= 0 and got[1] == 240


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_poly_fit(spark, degree):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 12, 300)
    y = 1 + 2 * x - 0.3 * x**2 + 0.02 * x**3 + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fit = reg.poly_fit(df, [], "x", "y", degree)
    line = reg.poly_grid(fit, [], degree, F.lit(12.0)).toPandas()
    assert len(line) == 24
    assert np.allclose(line.y, np.polyval(np.polyfit(x, y, degree), line.x), atol=1e-6)


def test_p_values():
    # Student's t, two-sided, from tables
    got = reg.t_two_sided(np.array([12.706, 2.228, 1.96, 0.0]), np.array([1, 10, 1e6, 5]))
    assert np.allclose(got, [0.05, 0.05, 0.05, 1.0], atol=1e-4)


def test_calibrated_mu_closes_the_balance(v, spark):
    ref = v.par.select("glacier_id", F.lit(-150.0).alias("ref_mb"))
    cal = mb.calibrate_mu(v.mon, v.par, v.bins, ref, 1996, 2000)
    par = cal.where(F.col("mu").isNotNull()).select("glacier_id", F.col("calib_hgt").alias("ref_hgt"), "mu", F.lit(0.0).alias("bias"))
    back = mb.specific_mb(v.mon.where(F.col("yr").between(1996, 2000)), par, v.bins).groupBy("glacier_id").agg(F.avg("mb").alias("m"))
    assert back.count() > 0
    assert back.agg(F.max(F.abs(F.col("m") + 150))).first()[0] < 1e-6


def test_balance_is_zero_at_the_ela(v):
    ela = mb.equilibrium_line(v.mon, v.par).where(F.col("ela").isNotNull())
    spots = ela.select("glacier_id", F.col("yr").cast("long").alias("bin_id"), F.col("ela").alias("height"), F.lit(1.0).alias("width"))
    pts = mb.point_balance(mb.climate_on_height(v.mon, v.par, spots), annual=True).where(F.col("bin_id") == F.col("yr"))
    assert pts.agg(F.max(F.abs("mb"))).first()[0] < 1e-6


def test_climate_qc_reaches_its_goal(v):
    shifted = mb.climate_qc(v.mon, v.par, v.bins, 3)
    bot = v.bins.groupBy("glacier_id").agg(F.min("height").alias("z"))
    t = v.mon.join(shifted, "glacier_id").join(bot, "glacier_id").where(F.col("ref_hgt_diff") > 0)
    warm = t.groupBy("glacier_id", "yr").agg(F.count_if(F.col("temp") - 0.0065 * (F.col("z") - F.col("ref_hgt")) > -1).alias("n"))
    assert warm.where("n < 3").count() == 0


def test_random_years_use_each_year_once_per_cycle(spark):
    m = mb.random_years(spark, 2000, 30, list(range(1990, 2000)), seed=1).toPandas()
    for c in range(3):
        assert sorted(m.yr[c * 10 : c * 10 + 10]) == list(range(1990, 2000))
    assert m.equals(mb.random_years(spark, 2000, 30, list(range(1990, 2000)), seed=1).toPandas())
    assert not mb.random_years(spark, 2000, 30, list(range(1990, 2000)), seed=2).toPandas().equals(m)


def test_hashed_normals(spark):
    z = spark.range(20000).select(mb.hash_normal(3, "x", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_hampel_and_smoothing(spark):
    pdf = pd.DataFrame({"k": 1, "t": range(30), "y": np.sin(np.arange(30) / 5)})
    pdf.loc[12, "y"] = 30.0
    h = se.hampel(spark.createDataFrame(pdf), ["k"], "t", "y").orderBy("t").toPandas()
    assert list(h.index[h.is_outlier]) == [12] and abs(h.filtered[12]) < 1
    s = se.smooth1d(spark.createDataFrame(pdf), ["k"], "t", "y", window=3, kernel="mean").orderBy("t").toPandas()
    assert s.smooth[0] == pytest.approx((pdf.y[0] + 2 * pdf.y[1]) / 3)
    with pytest.raises(ValueError):
        se.kernel_weights(4, "mean")


def test_sign_change_and_gaps(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 0.0, -2.0, -1.0, 3.0])], "k int, t int, y double")
    got = [r["change"] for r in se.sign_change(df, ["k"], "t", "y").orderBy("t").collect()]
    assert got == [0, 0, 1, 0, 1]


def test_calendars(spark):
    df = spark.createDataFrame([(2000, m) for m in range(1, 13)], "yr int, mo int")
    y, m = sc.floatyear_to_date(sc.date_to_floatyear("yr", "mo"))
    assert [tuple(r) for r in df.select(y, m).collect()] == [(2000, k) for k in range(1, 13)]
    hy, hm = sc.calendar_to_hydro("yr", "mo", 10)
    assert [tuple(r) for r in df.select(hy, hm).collect()][9:] == [(2001, 1), (2001, 2), (2001, 3)]


def test_names(spark):
    df = spark.createDataFrame([("aletsch glacier30^",), (None,), ("north-COL  `",), ("à/0",)], "n string")
    assert [r[0] for r in df.select(sc.clean_name("n")).collect()] == ["Aletsch Glacier", "", "North-Col", "À"]


def test_strict_weighted_average_fails_on_zero_weights(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "x double, w double")
    with pytest.raises(Exception, match="sum to zero"):
        en.weighted_avg(df, [], "x", "w", strict=True).collect()
    assert en.weighted_avg(df, [], "x", "w").first()[0] is None


def test_skill_of_a_perfect_and_a_flat_model(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "obs double, sim double")
    r = en.skill(df).first()
    assert (r["nse"], r["r2"], r["rmse"], r["pbias"]) == (1.0, pytest.approx(1.0), 0.0, 0.0)
    flat = en.skill(df.withColumn("obs", F.lit(0.0))).first()
    assert flat["nse"] is None and flat["r2"] is None and flat["pbias"] is None
