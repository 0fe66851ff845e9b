"""Queries on model runs, calibration and set operations (W01.., A29-A37, S09-S12, U, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.functions import regression as reg
from glacierlens.functions.quantiles import group_quantiles
from glacierlens.operators import ensemble as en
from glacierlens.operators import series as se
from glacierlens.operators import setops as so
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R
from glacierlens.session import settle

RUN = ["rgi_id", "gcm", "ssp"]

# balance of each run; lead over the years of the run
_SMB = """smb as (select *, case when a1 <> 0 then (v1 - volume) / a1 when v1 <> volume and area <> 0 then (v1 - volume) / area end * 0.9e0 as smb
  from (select *, lead(volume) over w as v1, lead(area) over w as a1 from {src} window w as (partition by {k} order by yr)) where v1 is not null)"""
_RUN_SMB = _SMB.format(src="runs", k="rgi_id, gcm, ssp")
_TOT = """tot as (select rgi_id, yr, rgi_id // 10 as region, sum(volume) as volume, sum(area) as area from runs group by 1, 2, 3)"""
_REG = """reg as (select rgi_id // 10 as region, yr, sum(volume) as volume, sum(area) as area from runs group by 1, 2)"""


def _totals(v):
    """One series per glacier, models and scenarios summed."""
    return v.runs.groupBy("rgi_id", "yr").agg(F.sum("volume").alias("volume"), F.sum("area").alias("area")).withColumn(
        "region", F.floor(F.col("rgi_id") / 10)
    )


def _regions(v):
    return v.runs.groupBy(F.floor(F.col("rgi_id") / 10).alias("region"), "yr").agg(
        F.sum("volume").alias("volume"), F.sum("area").alias("area")
    )


@query("W01_specific_balance", f"with {_RUN_SMB} select rgi_id, gcm, ssp, yr, area, {R('smb')} as smb from smb")
def _(v):
    return rounded(en.specific_balance(v.runs, RUN))


@query("W02_cumulative_dh", f"""with {_RUN_SMB} select rgi_id, gcm, ssp, yr, {R('sum(smb / 0.9e0) over (partition by rgi_id, gcm, ssp order by yr)')} as dh from smb""")
def _(v):
    return rounded(en.cumulative_dh(en.specific_balance(v.runs, RUN), RUN).select(*RUN, "yr", "dh"))


@query("A32_ensemble_reduce", f"""with s as (select gcm, ssp, yr, sum(volume) as volume, sum(area) as area from runs group by 1, 2, 3)
select ssp, yr, {R('avg(volume)', 3)} as volume, {R('avg(area)', 3)} as area, count(*) as n_models from s group by 1, 2""")
def _(v):
    return rounded(en.ensemble_reduce(v.runs), 3)


_UNC = """u as (select r.gcm, r.ssp, r.yr, sum(r.volume) as volume, stddev_pop(r.volume) as sdv, sum(r.area) as area, stddev_pop(r.area) as sda,
  any_value(n.n) as n from runs r join (select gcm, ssp, count(distinct rgi_id) as n from runs group by 1, 2) n on r.gcm = n.gcm and r.ssp = n.ssp group by 1, 2, 3)"""


@query("A33_region_total_uncertainty", f"""with {_UNC} select gcm, ssp, yr, {R('volume', 4)} as total, {R('sdv', 4)} as sd, n, {R('sdv * sqrt(n)', 4)} as uncertainty from u""")
def _(v):
    return rounded(en.region_total_uncertainty(v.runs, ["gcm", "ssp"], "volume"), 4)


@query("A50_smb_uncertainty", f"""with {_UNC}, x as (select *, volume as volume0, sdv * sqrt(n) as ve, sda * sqrt(n) as ae from u),
s as (select *, lead(volume) over w as v1, lead(area) over w as a1, lead(ve) over w as ve1, lead(ae) over w as ae1 from x
  window w as (partition by gcm, ssp order by yr)),
b as (select *, (v1 - volume) / a1 * 0.9e0 as smb from s where v1 is not null),
e as (select *, sqrt(ve1 * ve1 + ve * ve + pow(smb * ae1, 2)) / a1 as e from b)
select gcm, ssp, yr, {R('smb')} as smb, {R('case when e > 20 or e is null then median(e) over (partition by gcm, ssp) else e end')} as smb_err from e""")
def _(v):
    keys = ["gcm", "ssp"]
    vol = en.region_total_uncertainty(v.runs, keys, "volume").select(
        *keys, "yr", F.col("total").alias("volume"), F.col("uncertainty").alias("volume_err")
    )
    area = en.region_total_uncertainty(v.runs, keys, "area").select(
        *keys, "yr", F.col("total").alias("area"), F.col("uncertainty").alias("area_err")
    )
    return rounded(en.smb_uncertainty(vol.join(area, [*keys, "yr"]), keys, limit=20.0))


@query("A34_weighted_avg", f"""with {_RUN_SMB} select ssp, yr, {R('sum(smb * area) filter (where area > 5) / sum(case when smb is not null and area > 5 then area end)')} as mean
from smb group by 1, 2""")
def _(v):
    # weights up to 5 are turned negative and must be ignored
    smb = en.specific_balance(v.runs, RUN).withColumn("w", F.when(F.col("area") > 5, F.col("area")).otherwise(-F.col("area")))
    return rounded(en.weighted_avg(smb, ["ssp", "yr"], "smb", "w"))


@query("A34b_weighted_avg_strict", f"""with {_RUN_SMB} select ssp, yr, {R('sum(smb * area) / sum(area)')} as mean from smb group by 1, 2""")
def _(v):
    return rounded(en.weighted_avg(en.specific_balance(v.runs, RUN), ["ssp", "yr"], "smb", "area", strict=True))


_PERIODS = [("p1", 1995, 1996), ("p2", 1997, 1998), ("p3", 1999, 2001)]


def _impact_sql(periods, label):
    case = "case " + " ".join(f"when s.yr between {a} and {b} then '{n}'" for n, a, b in periods) + " end"
    w = lambda c: f"sum(case when w > 0 and {c} is not null then {c} * w end) / sum(case when w > 0 and {c} is not null then w end)"
    return f"""with {_TOT}, {_SMB.format(src='tot', k='rgi_id')},
top as (select rgi_id, yr from (select rgi_id, yr, row_number() over (partition by rgi_id order by cast(area as bigint) % 9 desc, yr) as rn from tot) where rn <= 5),
r as (select s.region, {case} as period, s.rgi_id, s.area, case when abs(s.smb) <= 100 then s.smb end as x, t.yr is not null as ext
  from smb s left join top t on s.rgi_id = t.rgi_id and s.yr = t.yr),
g as (select region, period, rgi_id, coalesce(sum(x), 0) as s, avg(x) as m, min(area) as w,
  case when count(*) filter (where ext) > 0 then coalesce(sum(x) filter (where ext), 0) end as es, avg(x) filter (where ext) as em
  from r where period is not null group by 1, 2, 3),
h as (select *, case when abs(s) <= 500 then s end as s2, case when abs(s) <= 500 then m end as m2,
  case when abs(es) <= 500 then es end as es2, case when abs(es) <= 500 then em end as em2 from g),
o as (select region, period, {w('s2')} as s, {w('m2')} as a, {w('es2')} as e, {w('em2')} as ae from h group by 1, 2)
select region, period, {R('s')} as sum, {R('a')} as avg, {R('e')} as ext, {R('ae')} as avg_ext, {R('case when s <> 0 then e / s end')} as share from o"""


def _impact(v, periods):
    tot = _totals(v)
    smb = en.specific_balance(tot, ["rgi_id", "region"])
    scores = tot.select("rgi_id", "yr", (F.col("area").cast("long") % 9).alias("score"))
    return rounded(en.extreme_impact(smb, scores, periods))


@query("A35_extreme_impact", _impact_sql(_PERIODS, "p"))
def _(v):
    return _impact(v, _PERIODS)


_TWO = [("early", 1995, 1997), ("late", 1998, 2001)]


@query("A35b_extreme_impact_two_periods", _impact_sql(_TWO, "p"))
def _(v):
    return _impact(v, _TWO)


_PAIR = """pair as (select o.glacier_id, o.mb as obs, s.score * 10e0 - 200e0 as sim from obs_mb o join scores s on o.glacier_id = s.glacier_id and o.yr = s.yr)"""


def _pairs(v):
    return v.obs_mb.join(v.scores, ["glacier_id", "yr"]).select(
        "glacier_id", F.col("mb").alias("obs"), (F.col("score") * 10.0 - 200.0).alias("sim")
    )


@query("A36_skill", f"""with {_PAIR} select glacier_id, count(*) as n,
  {R('1 - sum((sim - obs) * (sim - obs)) / (count(*) * var_pop(obs))')} as nse, {R('pow(corr(sim, obs), 2)')} as r2,
  {R('sqrt(avg((sim - obs) * (sim - obs)))')} as rmse, {R('100 * sum(sim - obs) / sum(obs)')} as pbias from pair group by 1""")
def _(v):
    return rounded(en.skill(_pairs(v), ["glacier_id"]))


@query("A37_deviation_metrics", f"""with {_PAIR} select glacier_id, {R('avg(sim - obs)')} as md, {R('avg(abs(sim - obs))')} as mad,
  {R('sqrt(avg((sim - obs) * (sim - obs)))')} as rmsd, {R('sqrt(var_pop(sim - obs))')} as rmsd_bc,
  {R('avg((sim - obs) / obs)')} as rel_err, {R('corr(sim, obs)')} as corr from pair group by 1""")
def _(v):
    return rounded(en.deviation_metrics(_pairs(v), ["glacier_id"]))


_LEVELS = f"""{_REG}, {_SMB.format(src='reg', k='region')},
xy as (select s.yr, s.region, m.x, s.smb from smb s join (select glacier_id as region, yr, median(score) as x from scores group by 1, 2) m
  on s.region = m.region and s.yr = m.yr where s.smb is not null)"""


def _response(v):
    x = group_quantiles(v.scores.withColumnRenamed("glacier_id", "region"), ["region", "yr"], "score", {"score": 0.5}).drop("n")
    return en.specific_balance(_regions(v), ["region"]).join(x, ["region", "yr"]).where(F.col("smb").isNotNull())


@query("A51_binned_response", f"with {_LEVELS} select x as score, {R('avg(smb)')} as mean, {R('stddev_pop(smb)')} as sd, count(*) as n from xy group by 1")
def _(v):
    return rounded(en.binned_response(_response(v)))


def quad_sql(src: str, x: str, y: str, k: str = "") -> str:
    """Quadratic fit by two-predictor regression on x and x^2."""
    z = f"({x} * {x})"
    part = f"{k}, " if k else ""
    return f"""select {part}avg({x}) as mx, avg({z}) as mz, avg({y}) as my, var_pop({x}) as sxx, var_pop({z}) as szz,
  covar_pop({x}, {z}) as sxz, covar_pop({x}, {y}) as sxy, covar_pop({z}, {y}) as szy from {src}""" + (f" group by {k}" if k else "")


_QVAL = """my + (szz * sxy - sxz * szy) / (sxx * szz - sxz * sxz) * (g - mx) + (sxx * szy - sxz * sxy) / (sxx * szz - sxz * sxz) * (g * g - mz)"""


@query("A51b_response_bounds", f"""with {_LEVELS}, lv as (select x, avg(smb) as mean, stddev_pop(smb) as sd from xy group by 1),
rk as (select *, row_number() over (order by x desc) as rn, count(*) over () as k, max(x) over () as top from lv),
use as (select * from rk where k <= 2 or rn > 2),
u as ({quad_sql('use', 'x', '(mean + 1.5e0 * sd)')}), l as ({quad_sql('use', 'x', '(mean - 1.5e0 * sd)')}), m as ({quad_sql('use', 'x', 'mean')}),
g as (select unnest(generate_series(0, cast(ceil((max(top) + 1) / 0.5e0) as bigint) - 1)) * 0.5e0 as g from rk)
select g as x, {R('(select ' + _QVAL + ' from u)', 4)} as upper, {R('(select ' + _QVAL + ' from l)', 4)} as lower, {R('(select ' + _QVAL + ' from m)', 4)} as mean
from g""")
def _(v):
    levels = settle(en.binned_response(_response(v)))
    top = levels.agg(F.max("score")).scalar()
    use = en.drop_last_levels(levels, "score", 2)
    out = None
    for name, y in (("upper", F.col("mean") + 1.5 * F.col("sd")), ("lower", F.col("mean") - 1.5 * F.col("sd")), ("mean", F.col("mean"))):
        fit = reg.poly_fit(use.select("score", y.alias("_y")), [], "score", "_y", 2)
        line = reg.poly_grid(fit, [], 2, top + 1.0).withColumnRenamed("y", name)
        out = line if out is None else out.join(line, "x")
    return rounded(out, 4)


@query("A51c_response_correlation", f"with {_LEVELS} select {R('corr(x, smb)')} as corr, count(*) as n from xy")
def _(v):
    return rounded(_response(v).agg(reg.correlation(F.col("score"), F.col("smb")).alias("corr"), F.count("*").alias("n")))


@query("T05_poly_fit", f"""with f as ({quad_sql('fp', 'obs_day', 'dh', 'region15')}),
g as (select unnest(generate_series(0, 19)) * 0.5e0 as g) select region15, g as x, {R(_QVAL, 4)} as y from f, g""")
def _(v):
    fit = reg.poly_fit(v.fp, ["region15"], "obs_day", "dh", 2)
    return rounded(reg.poly_grid(fit, ["region15"], 2, F.lit(10.0)), 4)


_SCEN = f"""r as (select rgi_id // 10 as region, ssp as scenario, yr, sum(volume) as volume, sum(area) as area from runs group by 1, 2, 3),
{_SMB.format(src='r', k='region, scenario')}"""


def _scenarios(v):
    r = v.runs.groupBy(F.floor(F.col("rgi_id") / 10).alias("region"), F.col("ssp").alias("scenario"), "yr").agg(
        F.sum("volume").alias("volume"), F.sum("area").alias("area")
    )
    return en.specific_balance(r, ["region", "scenario"])


@query("A55_sensitivity_compare", "with " + _SCEN + " select region, " + ", ".join(
    f"""{R(f"max(case when scenario = '{s}' then smb end)")} as "{s}" """ for s in "1234"
) + " from smb where yr = 1997 group by 1")
def _(v):
    return rounded(en.sensitivity_compare(_scenarios(v), 1997, list("1234")))


@query("K02_ranking", "with " + _SCEN + f" select region, {R('smb')} as smb from smb where scenario = '1' and yr = 1997 order by smb")
def _(v):
    one = _scenarios(v).where((F.col("scenario") == "1") & (F.col("yr") == 1997))
    return rounded(one.select("region", "smb")).orderBy("smb")


@query("A56_decade_compare", "with " + _SCEN + f""" select region, scenario, {R('avg(smb) filter (where yr between 1995 and 1997)')} as early_mean,
  {R('stddev_pop(smb) filter (where yr between 1995 and 1997)')} as early_sd, {R('avg(smb) filter (where yr between 1998 and 2001)')} as recent_mean,
  {R('stddev_pop(smb) filter (where yr between 1998 and 2001)')} as recent_sd from smb group by 1, 2""")
def _(v):
    return rounded(en.decade_compare(_scenarios(v), ["region", "scenario"], (1995, 1997), (1998, 2001)))


# ---- geodetic rates and calibration

@query("A29_regional_mass_balance", f"""select region, {R('sum(dmdtda * area) / sum(area)')} as rate, count(dmdtda) as n from
(select region, case when rgi_id % 13 = 0 then null else dmdtda end as dmdtda, case when rgi_id % 13 = 0 then null else area end as area from geodetic) group by 1""")
def _(v):
    g = v.geodetic.withColumn("dmdtda", F.when(F.col("rgi_id") % 13 != 0, F.col("dmdtda")))
    return rounded(en.regional_mass_balance(g, ["region"]))


_HALF = "case when rgi_id % 2 = 0 then 'p1' else 'p2' end"


@query("A30_calibration_factors", f"""with o as (select region, {_HALF} as period, sum(dmdtda * area) / sum(area) as rate from geodetic group by 1, 2),
m as (select region, {_HALF} as period, sum((dmdtda * 0.8e0 - 0.1e0) * area) / sum(area) as rate from geodetic group by 1, 2)
select o.region, o.period, {R('o.rate')} as obs_rate, {R('m.rate')} as model_rate, {R('o.rate / (m.rate / 0.85e0)')} as factor
from o join m on o.region = m.region and o.period = m.period""")
def _(v):
    g = v.geodetic.withColumn("period", F.expr(_HALF))
    keys = ["region", "period"]
    obs = en.regional_mass_balance(g, keys)
    model = en.regional_mass_balance(g.withColumn("dmdtda", F.col("dmdtda") * 0.8 - 0.1), keys)
    return rounded(en.calibration_factors(obs, model, keys))


_CAL = """mem as (select rgi_id, region as r, region as o from geodetic union all
  select rgi_id, (region + 1) % 25, (region + 1) % 25 from geodetic where rgi_id % 3 = 0),
fst as (select rgi_id, arg_min(r, o) as region from mem group by 1),
cal as (select f.region, g.rgi_id, g.dmdtda, g.area, g.dmdtda * (0.8e0 + n.n_nationkey * 0.02e0) as calibrated
  from geodetic g join fst f on g.rgi_id = f.rgi_id join nation n on f.region = n.n_nationkey)"""


def _calibrated(v):
    g = v.geodetic
    nxt = (F.col("region") + 1) % 25
    member = g.select("rgi_id", "region", F.col("region").alias("region_order")).unionByName(
        g.where(F.col("rgi_id") % 3 == 0).select("rgi_id", nxt.alias("region"), nxt.alias("region_order"))
    )
    factors = v.table("nation").select(
        F.col("n_nationkey").alias("region"), (0.8 + F.col("n_nationkey") * 0.02).alias("factor")
    )
    return en.calibrate_by_region(g.drop("region"), member, factors)


@query("A31_calibrate_by_region", f"with {_CAL} select region, rgi_id, {R('dmdtda')} as dmdtda, {R('calibrated')} as calibrated from cal")
def _(v):
    return rounded(_calibrated(v).select("region", "rgi_id", "dmdtda", "calibrated"))


@query("A31b_calibration_report", f"""with {_CAL} select region, {R('sum(dmdtda * area) / sum(area)')} as before,
  {R('sum(calibrated * area) / sum(area)')} as after from cal group by 1""")
def _(v):
    return rounded(en.calibration_report(_calibrated(v)))


_MODEL = """model as (select rgi_id, rgi_id // 10 as region, avg(volume / area) as smb, (rgi_id % 4) * 2e0 as calving, avg(area) * 1e5 as area
  from runs group by 1, 2)"""


def _model(v):
    return v.runs.groupBy("rgi_id").agg(
        F.avg(F.col("volume") / F.col("area")).alias("smb"), (F.avg("area") * 1e5).alias("area")
    ).withColumn("calving", (F.col("rgi_id") % 4) * 2.0).withColumn("region", F.floor(F.col("rgi_id") / 10))


_RES = f"""{_MODEL}, res as (select sum(g.dmdtda * 1000e0 * g.area) / sum(g.area) as reference,
  sum((m.smb - m.calving) * m.area) / sum(m.area) as model from model m join geodetic g on m.rgi_id = g.rgi_id where not g.is_cor)"""


@query("A47_geodetic_residual", f"with {_RES} select {R('reference')} as reference, {R('model')} as model, {R('reference - model')} as residual from res")
def _(v):
    return rounded(en.geodetic_residual(_model(v), v.geodetic))


@query("A47b_regional_residual", f"""with {_MODEL} select region, {R('sum((smb - calving) * area) / sum(area)')} as model,
  region * 3e0 - 40e0 as reference, {R('(region * 3e0 - 40e0) - sum((smb - calving) * area) / sum(area)')} as residual from model group by 1""")
def _(v):
    ref = v.table("nation").select(
        F.col("n_nationkey").cast("long").alias("region"), (F.col("n_nationkey") * 3.0 - 40.0).alias("reference")
    )
    return rounded(en.regional_residual(_model(v), ref))


@query("M13_apply_bias_shift", f"""with {_RES} select glacier_id, ref_hgt / 10e0 as bias_before, {R('ref_hgt / 10e0 - (select reference - model from res)')} as bias from gl""")
def _(v):
    params = v.gl.select("glacier_id", (F.col("ref_hgt") / 10.0).alias("bias"))
    return rounded(en.apply_bias_shift(params, en.geodetic_residual(_model(v), v.geodetic)))


# ---- series of runs

@query("W13_winter_difference", f"""with w as (select region15, cast(case when month(obs_date) >= 11 then year(obs_date) else year(obs_date) - 1 end as int) as winter,
  median(dh) as med from fp where month(obs_date) in (11, 12, 1, 2, 3) group by 1, 2)
select a.region15, a.winter, {R('a.med')} as med, {R('a.med - b.med')} as difference from w a left join w b on a.region15 = b.region15 and b.winter = a.winter - 1""")
def _(v):
    return rounded(se.winter_difference(v.fp, ["region15"], "obs_date", "dh"))


@query("W14_annual_difference", """select a.glacier_id, a.yr, a.score - b.score as difference from
(select * from scores where yr <> 1998) a left join (select * from scores where yr <> 1998) b on a.glacier_id = b.glacier_id and b.yr = a.yr - 1""")
def _(v):
    # one year is taken out to show the gap rule
    s = v.scores.where(F.col("yr") != 1998)
    return se.annual_difference(s, ["glacier_id"], "score").select("glacier_id", "yr", "difference")


_PCT = """tv as (select rgi_id, yr, sum(volume) as volume from runs group by 1, 2),
pc as (select rgi_id, yr, volume / first_value(volume) over (partition by rgi_id order by yr) * 100 as percent from tv)"""


@query("W15_percent_of_start", f"with {_PCT} select rgi_id, yr, {R('percent')} as percent from pc")
def _(v):
    return rounded(en.percent_of_start(_totals(v), ["rgi_id"], "volume").select("rgi_id", "yr", "percent"))


@query("W15b_first_year_below", f"""with {_PCT}, cuts as (select rgi_id, cast(c as int) as cut from (select distinct rgi_id from pc), (select unnest(generate_series(0, 90)) as c))
select k.rgi_id, k.cut, min(pc.yr) as year from cuts k left join pc on k.rgi_id = pc.rgi_id and pc.percent <= k.cut group by 1, 2""")
def _(v):
    return en.first_year_below(en.percent_of_start(_totals(v), ["rgi_id"], "volume"), ["rgi_id"])


@query("W16_loss_summary", f"""with {_REG} select region, {R('1 - max(case when yr = 1998 then volume end) / max(case when yr = 1995 then volume end)')} as loss_past,
  {R('(max(case when yr = 1998 then volume end) - max(case when yr = 2001 then volume end)) / max(case when yr = 1995 then volume end)')} as loss_future
from reg group by 1""")
def _(v):
    return rounded(en.loss_summary(_regions(v), ["region"], "volume", 1995, 1998, 2001))


@query("W16b_loss_metres", f"""with {_REG} select region, {R('max(case when yr = 1995 then area end) - max(case when yr = 1998 then area end)')} as loss_past,
  {R('max(case when yr = 1998 then area end) - max(case when yr = 2001 then area end)')} as loss_future from reg group by 1""")
def _(v):
    return rounded(en.loss_summary(_regions(v), ["region"], "area", 1995, 1998, 2001, relative=False))


@query("W25_concat_runs", f"""with f as (select rgi_id, yr, sum(volume) as volume, sum(area) as melt from runs where yr <= 1999 group by 1, 2),
s as (select rgi_id, yr, sum(volume) as volume, sum(area) as melt from runs where yr >= 1999 group by 1, 2),
l as (select rgi_id, max(yr) as ly, arg_max(melt, yr) as c from f group by 1)
select f.rgi_id, f.yr, {R('volume')} as volume, {R('melt')} as melt from f join l on f.rgi_id = l.rgi_id where f.yr < l.ly
union all select s.rgi_id, s.yr, {R('volume')}, {R('melt + coalesce(l.c, 0)')} from s left join l on s.rgi_id = l.rgi_id""")
def _(v):
    t = _totals(v).select("rgi_id", "yr", "volume", F.col("area").alias("melt"))
    return rounded(en.concat_runs(t.where(F.col("yr") <= 1999), t.where(F.col("yr") >= 1999), "rgi_id", ["melt"]))


@query("W26_clip_run", f"select rgi_id, gcm, ssp, yr, {R('volume')} as volume, area from runs where yr <= 1998")
def _(v):
    return rounded(en.clip_run(v.runs, 1998))


# ---- assembly

@query("S09_assemble_climate", f"""with ax as (select distinct yr, mo from mon), g as (select glacier_id, ref_hgt, cen_lon, cen_lat from gl)
select g.glacier_id, {R('ref_hgt')} as ref_hgt, {R('cen_lon')} as cen_lon, {R('cen_lat')} as cen_lat, ax.yr, ax.mo, {R('m.temp')} as temp, {R('m.prcp')} as prcp
from g cross join ax left join mon m on g.glacier_id = m.glacier_id and ax.yr = m.yr and ax.mo = m.mo""")
def _(v):
    g = v.gl.select("glacier_id", "ref_hgt", "cen_lon", "cen_lat")
    return rounded(en.assemble_climate(v.mon, g))


@query("S10_assemble_runs", f"""with r as (select rgi_id, yr, sum(volume) as volume, sum(area) as area from runs group by 1, 2),
ax as (select distinct yr from r), ids as (select distinct rgi_id from r)
select ids.rgi_id, ax.yr, {R('r.volume')} as volume, r.area from ids cross join ax left join r on r.rgi_id = ids.rgi_id and r.yr = ax.yr""")
def _(v):
    r = v.runs.groupBy("rgi_id", "yr").agg(F.sum("volume").alias("volume"), F.sum("area").alias("area"))
    return rounded(en.assemble_axis(r, "rgi_id", "yr", ["volume", "area"]))


@query("S11_combine_members", f"""select rgi_id, yr, gcm, ssp, {R('volume')} as volume, case when gcm = 'F' and ssp = '2' then null else area end as area from runs""")
def _(v):
    def member(gcm, ssp):
        part = v.runs.where((F.col("gcm") == gcm) & (F.col("ssp") == ssp)).drop("gcm", "ssp")
        return part.drop("area") if (gcm, ssp) == ("F", "2") else part

    return rounded(en.combine_members([(member(g, s), g, s) for g in "FOP" for s in "12345"]))


# ---- set operations and order

@query("U01_merge_missions", f"""select track, obs_date, {R('dh')} as dh from fp where track in ('AF', 'AO')
union all select track, obs_date, {R('dh')} from fp where track in ('NF', 'NO') and obs_date < date '1999-01-01'
union all select track, obs_date, {R('dh')} from fp where track in ('RF', 'RO') and obs_date >= date '1999-01-01'""")
def _(v):
    p = v.fp.select("track", "obs_date", "dh")
    pick = lambda a: p.where(F.col("track").startswith(a))
    return rounded(so.merge_missions(pick("A"), pick("N"), pick("R"), "1999-01-01"))


@query("U02_union_regions", f"select rgi_id, region, {R('dmdtda')} as dmdtda, area, is_cor from geodetic where region in (13, 14, 15)")
def _(v):
    return rounded(so.union_regions([v.geodetic.where(F.col("region") == r) for r in (13, 14, 15)]))


@query("U03_id_intersection", "select rgi_id from geodetic intersect select rgi_id from runs")
def _(v):
    return so.id_intersection(v.geodetic, v.runs, "rgi_id")


@query("U04_id_difference", f"select rgi_id, region, {R('dmdtda')} as dmdtda, area, is_cor from geodetic where rgi_id not in (select rgi_id from runs)")
def _(v):
    return rounded(so.id_difference(v.geodetic, v.runs, "rgi_id"))


@query("U05_distinct_levels", "select distinct yr, score from scores")
def _(v):
    return v.scores.select("yr", "score").distinct()


@query("K01_ordered_output", f"select glacier_id, yr, mo, {R('temp')} as temp from mon order by yr, mo, glacier_id")
def _(v):
    return rounded(v.mon.select("glacier_id", "yr", "mo", "temp")).orderBy("yr", "mo", "glacier_id")


@query("K04_first_last_rows", """(select 'first' as part, rgi_id from (select distinct rgi_id from geodetic) order by rgi_id limit 5 offset 2)
union all (select 'last', rgi_id from (select distinct rgi_id from geodetic) order by rgi_id desc limit 5)""")
def _(v):
    ids = v.geodetic.select("rgi_id").distinct()
    first = so.first_rows(ids, ["rgi_id"], 5, skip=2).withColumn("part", F.lit("first"))
    return first.unionByName(so.last_rows(ids, ["rgi_id"], 5).withColumn("part", F.lit("last")))
