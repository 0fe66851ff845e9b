"""Queries on bias correction, scenarios, series filters and robust trends (W, C, J15, T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glacierlens.functions import regression as reg
from glacierlens.operators import scenario as sn
from glacierlens.operators import series as se
from glacierlens.operators import trends as tr
from glacierlens.plans import trend_sql
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R

MEMBER = ["glacier_id", "gcm", "ssp"]


# ---- W04-W06: bias correction

def _delta_sql(std: bool) -> str:
    scaled = """avg(temp) over near + (temp - avg(temp) over near) * (rs / nullif(stddev_pop(case when yr between 1996 and 1999 then temp end) over m, 0))""" if std else "temp"
    return f"""with r as (select glacier_id, mo, avg(temp) as rt, avg(prcp) as rp, stddev_pop(temp) as rs from mon where yr between 1996 and 1999 group by 1, 2),
s as (select e.glacier_id, gcm, ssp, yr, e.mo, prcp, rt, rp, {scaled} as temp from ens e join r on e.glacier_id = r.glacier_id and e.mo = r.mo
  window m as (partition by e.glacier_id, gcm, ssp, e.mo), near as (partition by e.glacier_id, gcm, ssp, e.mo order by yr rows between 2 preceding and 2 following)),
a as (select glacier_id, gcm, ssp, mo, avg(temp) as mt, avg(prcp) as mp from s where yr between 1996 and 1999 group by 1, 2, 3, 4)
select s.glacier_id, s.gcm, s.ssp, s.yr, s.mo, {R('s.temp - a.mt + s.rt')} as temp,
  {R('case when mp is null or s.prcp is null or s.rp is null then null when mp <> 0 then greatest(s.prcp / a.mp * s.rp, 0) else greatest(s.prcp - a.mp + s.rp, 0) end', 5)} as prcp
from s left join a on s.glacier_id = a.glacier_id and s.gcm = a.gcm and s.ssp = a.ssp and s.mo = a.mo"""


def _delta(v, std):
    out = sn.delta_method(v.ens, v.mon, 1996, 1999, scale_std=std)
    return rounded(out.withColumn("prcp", F.round(F.col("prcp") + 1.3e-7, 5)))


@query("W04_delta_method", _delta_sql(True))
def _(v):
    return _delta(v, True)


@query("W04b_delta_method_plain", _delta_sql(False))
def _(v):
    return _delta(v, False)


@query("W05_splice", f"""with h as (select glacier_id, yr, mo, avg(temp) as temp, avg(prcp) as prcp from ens group by 1, 2, 3)
select glacier_id, yr, mo, {R('temp')} as temp, {R('prcp')} as prcp from h where yr < 1998
union all select glacier_id, yr, mo, {R('temp')}, {R('prcp')} from mon where yr >= 1998""")
def _(v):
    h = v.ens.groupBy("glacier_id", "yr", "mo").agg(F.avg("temp").alias("temp"), F.avg("prcp").alias("prcp"))
    return rounded(sn.splice(h, v.mon.where(F.col("yr") >= 1998)))


def _q(arr, tau):
    """Linear quantile of a sorted DuckDB list."""
    pos = f"((len({arr}) - 1) * {tau})"
    a = f"{arr}[cast(floor({pos}) as bigint) + 1]"
    b = f"coalesce({arr}[cast(floor({pos}) as bigint) + 2], {a})"
    return f"({a} + ({b} - {a}) * ({pos} - floor({pos})))"


def _qdm_sql(kind: str) -> str:
    def tau(c):
        if kind == "count":
            return f"cume_dist() over (partition by glacier_id, gcm, ssp, mo order by {c})"
        return (f"(rank() over (partition by glacier_id, gcm, ssp, mo order by {c})"
                f" + (count(*) over (partition by glacier_id, gcm, ssp, mo, {c}) - 1) / 2e0) / count(*) over (partition by glacier_id, gcm, ssp, mo)")

    fin = lambda c: f"({c} is not null and {c} <= 4)"
    return f"""with o as (select glacier_id, mo, list_sort(list(temp)) as ot, list_sort(list(prcp)) as op from mon where yr <= 1998 group by 1, 2),
h as (select glacier_id, gcm, ssp, mo, list_sort(list(temp)) as ht, list_sort(list(prcp)) as hp from ens where yr <= 1998 group by 1, 2, 3, 4),
ha as (select glacier_id, gcm, ssp, median(prcp) as hall from ens where yr <= 1998 group by 1, 2, 3),
fa as (select glacier_id, gcm, ssp, median(prcp) as fall from ens where yr >= 1999 group by 1, 2, 3),
f as (select *, {tau('temp')} as tt, {tau('prcp')} as tp, median(prcp) over (partition by glacier_id, gcm, ssp, mo) as fmed from ens where yr >= 1999),
j as (select f.*, ot, op, ht, hp, f.prcp / nullif({_q('hp', 'tp')}, 0) as r1, fmed / nullif({_q('hp', '0.5e0')}, 0) as r2, fall / nullif(hall, 0) as r3
  from f join o on f.glacier_id = o.glacier_id and f.mo = o.mo
  join h on f.glacier_id = h.glacier_id and f.gcm = h.gcm and f.ssp = h.ssp and f.mo = h.mo
  join ha on f.glacier_id = ha.glacier_id and f.gcm = ha.gcm and f.ssp = ha.ssp join fa on f.glacier_id = fa.glacier_id and f.gcm = fa.gcm and f.ssp = fa.ssp)
select glacier_id, gcm, ssp, yr, mo, {R(_q('ot', 'tt') + ' + temp - ' + _q('ht', 'tt'))} as temp,
  {R('greatest(' + _q('op', 'tp') + f' * case when {fin("r1")} then r1 when {fin("r2")} then r2 else r3 end, 0)', 5)} as prcp from j"""


def _qdm(v, kind):
    hist, fut = v.ens.where(F.col("yr") <= 1998), v.ens.where(F.col("yr") >= 1999)
    out = sn.qdm(v.mon.where(F.col("yr") <= 1998), hist, fut, tau=kind)
    return rounded(out.withColumn("prcp", F.round(F.col("prcp") + 1.3e-7, 5)))


@query("W06_qdm", _qdm_sql("average"))
def _(v):
    return _qdm(v, "average")


@query("W06b_qdm_count", _qdm_sql("count"))
def _(v):
    return _qdm(v, "count")


def _trended(df, keys):
    return tr.seasonal_trend(df, keys, ["yr", "mo"], ["temp", "prcp"])


@query("W07_detrended_qm")
def _(v):
    obs = _trended(v.mon, ["glacier_id"]).where(F.col("yr") <= 1998)
    # series too short for a trend stay, without values
    fut = _trended(v.ens, MEMBER).where(F.col("yr") >= 1999)
    return rounded(sn.detrended_qm(obs, fut))


# ---- W09-W12: future extremes

_FUT = """f as (select * from ens where yr >= 1998),
fq as (select glacier_id, gcm, ssp, quantile_cont(temp, 0.99) as t99, quantile_cont(temp, 0.95) as t95, quantile_cont(temp, 0.9) as t90,
  quantile_cont(prcp, 0.01) as p01, quantile_cont(prcp, 0.05) as p05, quantile_cont(prcp, 0.1) as p10 from f group by 1, 2, 3),
fs as (select f.glacier_id, f.gcm, f.ssp, yr, sum(case when temp >= t99 then 4e0 when temp >= t95 then 2e0 when temp >= t90 then 1e0 else 0e0 end) as temp_score,
  sum(case when prcp <= p01 then 4e0 when prcp <= p05 then 2e0 when prcp <= p10 then 1e0 else 0e0 end) as prcp_score
  from f join fq on f.glacier_id = fq.glacier_id and f.gcm = fq.gcm and f.ssp = fq.ssp group by 1, 2, 3, 4)"""
_RANK = f"""{_FUT}, fr as (select *,
  cast(least(case when yr < 2001 then row_number() over (partition by glacier_id, gcm, ssp, yr < 2001 order by temp_score desc, yr desc)
    else row_number() over (partition by glacier_id, gcm, ssp order by temp_score desc, yr desc) end, 3) as int) as temp_rank,
  cast(least(case when yr < 2001 then row_number() over (partition by glacier_id, gcm, ssp, yr < 2001 order by prcp_score desc, yr desc)
    else row_number() over (partition by glacier_id, gcm, ssp order by prcp_score desc, yr desc) end, 3) as int) as prcp_rank from fs)"""
_MATCH = f"""{_RANK}, hr as (select glacier_id, yr, cast(row_number() over (partition by glacier_id order by score desc, yr desc) as int) as rk from scores where yr <= 1997),
ma as (select fr.*, a.yr as ty, b.yr as py from fr join hr a on fr.glacier_id = a.glacier_id and a.rk = ceil(temp_rank / 2e0)
  join hr b on fr.glacier_id = b.glacier_id and b.rk = ceil(prcp_rank / 2e0))"""


def _future_ranks(v):
    s = sn.future_year_scores(v.ens.where(F.col("yr") >= 1998))
    s = sn.reverse_rank(s, MEMBER, "temp_score", "temp_rank", split=2001, cap=3)
    return sn.reverse_rank(s, MEMBER, "prcp_score", "prcp_rank", split=2001, cap=3)


def _hist_ranks(v):
    return sn.reverse_rank(v.scores.where(F.col("yr") <= 1997), ["glacier_id"], "score", "rank")


def _matched(v, var):
    return sn.rank_match(_future_ranks(v).withColumn("rank", F.col(f"{var}_rank")), _hist_ranks(v), "rank")


@query("W09_future_year_scores", f"with {_FUT} select * from fs")
def _(v):
    return sn.future_year_scores(v.ens.where(F.col("yr") >= 1998))


@query("W10_reverse_rank", f"with {_RANK} select * from fr")
def _(v):
    return _future_ranks(v)


@query("J15_rank_match", f"with {_MATCH} select glacier_id, gcm, ssp, yr, temp_rank as rank, ty as hist_yr from ma")
def _(v):
    return _matched(v, "temp").select(*MEMBER, "yr", "rank", "hist_yr")


_SCALE = """oa as (select glacier_id, yr, temp - avg(temp) over (partition by glacier_id, yr) as t, prcp - avg(prcp) over (partition by glacier_id, yr) as p from mon),
ea as (select glacier_id, gcm, ssp, yr, temp - avg(temp) over (partition by glacier_id, gcm, ssp, yr) as t, prcp - avg(prcp) over (partition by glacier_id, gcm, ssp, yr) as p from ens),
os as (select glacier_id, yr, sum(greatest(t, 0)) as t, sum(least(p, 0)) as p from oa group by 1, 2),
es as (select glacier_id, gcm, ssp, yr, sum(greatest(t, 0)) as t, sum(least(p, 0)) as p from ea group by 1, 2, 3, 4),
kt as (select ma.glacier_id, ma.gcm, ma.ssp, ma.yr, case when e.t <> 0 and o.t / e.t > 2 then 2e0 when e.t <> 0 then o.t / e.t when o.t > 0 then 2e0 end as k from ma join os o on o.glacier_id = ma.glacier_id and o.yr = ty
  join es e on e.glacier_id = ma.glacier_id and e.gcm = ma.gcm and e.ssp = ma.ssp and e.yr = ty),
kp as (select ma.glacier_id, ma.gcm, ma.ssp, ma.yr, case when e.p <> 0 and o.p / e.p > 2 then 2e0 when e.p <> 0 then o.p / e.p when o.p > 0 then 2e0 end as k from ma join os o on o.glacier_id = ma.glacier_id and o.yr = py
  join es e on e.glacier_id = ma.glacier_id and e.gcm = ma.gcm and e.ssp = ma.ssp and e.yr = py),
x as (select e.*, avg(temp) over (partition by e.glacier_id, e.gcm, e.ssp, e.yr) as mt, avg(prcp) over (partition by e.glacier_id, e.gcm, e.ssp, e.yr) as mp, kt.k as a, kp.k as b
  from ens e left join kt on e.glacier_id = kt.glacier_id and e.gcm = kt.gcm and e.ssp = kt.ssp and e.yr = kt.yr
  left join kp on e.glacier_id = kp.glacier_id and e.gcm = kp.gcm and e.ssp = kp.ssp and e.yr = kp.yr)"""


@query("W11_rank_scaling", f"""with {_MATCH}, {_SCALE}
select glacier_id, gcm, ssp, yr, mo, {R('''case when a is not null and temp - mt >= 0 then mt + (temp - mt) * a when a is not null and temp - mt < 0 then mt + (temp - mt) * 1.5e0 else temp end''')} as temp,
  {R('case when prcp is not null then greatest(case when b is not null and prcp - mp <= 0 then mp + (prcp - mp) * b else prcp end, 0) end', 5)} as prcp from x""")
def _(v):
    kt = sn.year_scaling(v.mon, v.ens, _matched(v, "temp"), "temp", True)
    kp = sn.year_scaling(v.mon, v.ens, _matched(v, "prcp"), "prcp", False)
    out = sn.rank_scaling(v.ens, kt, kp, cooling=1.5)
    return rounded(out.withColumn("prcp", F.round(F.col("prcp") + 1.3e-7, 5)))


def _year_means(df, keys):
    """Yearly means stand in for the long-term trend, so that SQL can follow."""
    w = Window.partitionBy(*keys, "yr")
    return df.withColumn("temp_trend", F.avg("temp").over(w)).withColumn("prcp_trend", F.avg("prcp").over(w))


def _window_sql(scale: bool) -> str:
    kt = "kt * case when tf > 0 then 1 + g else 1 - g end" if scale else "kt"
    kp = "kp * case when pf > 0 then 1 - g else 1 + g end" if scale else "kp"
    return f"""with o as (select glacier_id, yr, mo, temp - avg(temp) over (partition by glacier_id, yr) as t, prcp - avg(prcp) over (partition by glacier_id, yr) as p from mon),
m as (select *, avg(temp) over (partition by glacier_id, gcm, ssp, yr) as tt, avg(prcp) over (partition by glacier_id, gcm, ssp, yr) as pp from ens),
r as (select m.glacier_id, m.gcm, m.ssp, (m.yr - 1996) * 12 + m.mo - 1 as i, o.t / nullif(m.temp - m.tt, 0) as a, o.p / nullif(m.prcp - m.pp, 0) as b
  from m join o on m.glacier_id = o.glacier_id and m.yr = o.yr and m.mo = o.mo where m.yr between 1996 and 1997),
k as (select glacier_id, gcm, ssp, i, case when a < 0 then 1e0 when a > 2 then 2e0 else a end as kt, case when b < 0 then 1e0 when b > 2 then 2e0 else b end as kp from r),
j as (select m.*, temp - tt as tf, prcp - pp as pf, case when m.yr >= 1999 then (m.yr - 1999) / 2e0 * 0.2e0 else 0e0 end as g, kt, kp
  from m left join k on m.glacier_id = k.glacier_id and m.gcm = k.gcm and m.ssp = k.ssp
    and k.i = case when m.yr between 1996 and 1997 then (m.yr - 1996) * 12 + m.mo - 1 when m.yr >= 1999 then ((m.yr - 1999) * 12 + m.mo - 1) % 24 end)
select glacier_id, gcm, ssp, yr, mo, {R(f'case when kt is not null then tt + tf * ({kt}) else temp end')} as temp,
  {R(f'greatest(case when kp is not null then pp + pf * ({kp}) else prcp end, 0)', 5)} as prcp from j"""


def _window(v, scale):
    obs, model = _year_means(v.mon, ["glacier_id"]), _year_means(v.ens, MEMBER)
    out = sn.window_scaling(obs, model, 1996, 1997, 1999, 2001, scale=scale)
    return rounded(out.withColumn("prcp", F.round(F.col("prcp") + 1.3e-7, 5)))


@query("W12_window_scaling", _window_sql(False))
def _(v):
    return _window(v, None)


@query("W12b_window_scaling_growing", _window_sql(True))
def _(v):
    return _window(v, 0.2)


# ---- W03, W19-W21: filters of one series

@query("W03_hampel", f"""with w as (select glacier_id, yr, mo, temp, list(temp) over (partition by glacier_id order by yr, mo rows between 5 preceding and 5 following) as l from mon),
m as (select *, list_aggregate(l, 'median') as med from w),
d as (select *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') as mad from m)
select glacier_id, yr, mo, abs(temp - med) > 3 * 1.4826e0 * mad as is_outlier, {R('case when abs(temp - med) > 3 * 1.4826e0 * mad then med else temp end')} as filtered from d""")
def _(v):
    m = v.mon.withColumn("t", F.col("yr") * 12 + F.col("mo"))
    out = se.hampel(m, ["glacier_id"], "t", "temp")
    return rounded(out.select("glacier_id", "yr", "mo", "is_outlier", "filtered"))


@query("W19_smooth1d", f"""with s as (select glacier_id, yr, mo, temp, row_number() over (partition by glacier_id order by yr, mo) - 1 as i, count(*) over (partition by glacier_id) as n from mon),
o as (select o, exp(-0.5e0 * o * o) / sum(exp(-0.5e0 * o * o)) over () as w from (select unnest(generate_series(-4, 4)) as o)),
j as (select s.*, o.w, ((i + o) % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) as q from s, o),
k as (select *, case when q >= n then 2 * (n - 1) - q else q end as r from j)
select k.glacier_id, k.yr, k.mo, {R('sum(k.w * s.temp)')} as smooth from k join s on k.glacier_id = s.glacier_id and k.r = s.i group by 1, 2, 3""")
def _(v):
    m = v.mon.withColumn("t", F.col("yr") * 12 + F.col("mo"))
    return rounded(se.smooth1d(m, ["glacier_id"], "t", "temp").select("glacier_id", "yr", "mo", "smooth"))


@query("W20_interp_nulls", f"""with s as (select glacier_id, yr, mo, case when mo in (1, 6, 7, 8) or yr = 2001 then null else temp end as x,
  row_number() over (partition by glacier_id order by yr, mo) as i from mon),
b as (select *, max(case when x is not null then i end) over (partition by glacier_id order by i) as i0,
  min(case when x is not null then i end) over (partition by glacier_id order by i rows between current row and unbounded following) as i1 from s)
select b.glacier_id, b.yr, b.mo, {R('case when b.x is not null then b.x when i0 is null then n.x when i1 is null then p.x else p.x + (n.x - p.x) * (b.i - i0) / (i1 - i0) end')} as filled
from b left join s p on p.glacier_id = b.glacier_id and p.i = b.i0 left join s n on n.glacier_id = b.glacier_id and n.i = b.i1""")
def _(v):
    gap = F.col("mo").isin(1, 6, 7, 8) | (F.col("yr") == 2001)
    m = v.mon.withColumn("t", F.col("yr") * 12 + F.col("mo")).withColumn("x", F.when(~gap, F.col("temp")))
    return rounded(se.interp_nulls(m, ["glacier_id"], "t", "x").select("glacier_id", "yr", "mo", "filled"))


@query("W21_sign_change", """with s as (select glacier_id, yr, mo, case when abs(temp) < 0.5e0 then 0 else sign(temp) end as x,
  row_number() over (partition by glacier_id order by yr, mo) as i, count(*) over (partition by glacier_id) as n from mon),
h as (select a.glacier_id, a.yr, a.mo, a.i, a.n, coalesce(arg_max(b.x, b.i) filter (where b.i <= a.i), arg_max(b.x, b.i)) as sg
  from s a join s b on a.glacier_id = b.glacier_id and b.x <> 0 group by 1, 2, 3, 4, 5)
select a.glacier_id, a.yr, a.mo, case when a.i = 1 and nx.sg = a.sg then 0 when p.sg <> a.sg then 1 else 0 end as change
from h a join h p on p.glacier_id = a.glacier_id and p.i = case when a.i = 1 then a.n else a.i - 1 end
left join h nx on nx.glacier_id = a.glacier_id and nx.i = a.i + 1""")
def _(v):
    m = v.mon.withColumn("t", F.col("yr") * 12 + F.col("mo")).withColumn("x", F.when(F.abs("temp") < 0.5, 0.0).otherwise(F.col("temp")))
    return se.sign_change(m, ["glacier_id"], "t", "x").select("glacier_id", "yr", "mo", "change")


# ---- C: scenario builders

_TREND = "tr as (select glacier_id, mo, regr_slope(temp, yr) as k from mon group by 1, 2)"
_OUT = "glacier_id, yr, mo, {t} as temp, {p} as prcp"
_COLS = ["glacier_id", "yr", "mo", "temp", "prcp"]


def _trends(v):
    return reg.linear_trend(v.mon, ["glacier_id", "mo"], "yr", "temp")


def _o(t, p="prcp", a=""):
    return f"{a}glacier_id, {a}yr, {a}mo, {R(t)} as temp, {R(p)} as prcp"


@query("C01_perturb", f"select {_o('case when yr = 1998 and mo in (6, 7, 8) then temp - 0.5e0 else temp end')} from mon")
def _(v):
    return rounded(sn.perturb(v.mon, "temp", 1998, [6, 7, 8], -0.5).select(*_COLS))


@query("C02_swap_decades", f"""with {_TREND} select {_o('temp')} from mon where yr not between 1998 and 2000
union all select m.glacier_id, cast(m.yr + 3 as int), m.mo, {R('temp + k * (m.yr + 3 - 1998)')}, {R('prcp')} from mon m join tr on m.glacier_id = tr.glacier_id and m.mo = tr.mo where m.yr between 1995 and 1997""")
def _(v):
    return rounded(sn.swap_decades(v.mon, _trends(v), (1995, 1997), (1998, 2000)).select(*_COLS))


@query("C02b_swap_decades_back", f"""with {_TREND} select {_o('temp')} from mon where yr not between 1995 and 1997
union all select m.glacier_id, cast(m.yr - 3 as int), m.mo, {R('temp - k * (m.yr - 3 - 1995)')}, {R('prcp')} from mon m join tr on m.glacier_id = tr.glacier_id and m.mo = tr.mo where m.yr between 1998 and 2000""")
def _(v):
    return rounded(sn.swap_decades(v.mon, _trends(v), (1995, 1997), (1998, 2000), forward=False).select(*_COLS))


def _trend_sql(sign):
    return f"""with {_TREND} select {_o(f'case when m.yr between 1997 and 2000 then temp {sign} k * (m.yr - 1997) else temp end', 'prcp', 'm.')}
from mon m join tr on m.glacier_id = tr.glacier_id and m.mo = tr.mo"""


@query("C03_detrend_years", _trend_sql("-"))
def _(v):
    return rounded(sn.detrend_years(v.mon, _trends(v), 1997, 2000).select(*_COLS))


@query("C03b_add_trend_years", _trend_sql("+"))
def _(v):
    return rounded(sn.add_trend_years(v.mon, _trends(v), 1997, 2000).select(*_COLS))


def _base_sql(warm):
    k = " + k * (y - 2001)" if warm else ""
    return f"""with {_TREND}, b as (select glacier_id, mo, avg(temp) as temp, avg(prcp) as prcp from mon where yr between 1996 and 1999 group by 1, 2)
select {_o('temp')} from mon where yr < 2001 union all
select b.glacier_id, cast(y as int), b.mo, {R(f'temp{k}')}, {R('prcp')} from b join tr on b.glacier_id = tr.glacier_id and b.mo = tr.mo, (select unnest(generate_series(2001, 2010)) as y)"""


@query("C04_extend_baseline", _base_sql(False))
def _(v):
    return rounded(sn.extend_baseline(v.mon, (1996, 1999), 2001, 2010).select(*_COLS))


@query("C04b_extend_baseline_warming", _base_sql(True))
def _(v):
    return rounded(sn.extend_baseline(v.mon, (1996, 1999), 2001, 2010, _trends(v)).select(*_COLS))


def _loop_sql(warm):
    k = " + k * (y - 2001)" if warm else ""
    return f"""with {_TREND} select {_o('temp')} from mon where yr < 2001 union all
select m.glacier_id, cast(y as int), m.mo, {R(f'temp{k}')}, {R('prcp')} from mon m join tr on m.glacier_id = tr.glacier_id and m.mo = tr.mo,
  (select unnest(generate_series(2001, 2010)) as y) where m.yr = 1997 + (y - 2001) % 4"""


@query("C05_extend_loop", _loop_sql(False))
def _(v):
    return rounded(sn.extend_loop(v.mon, (1997, 2000), 2001, 2010).select(*_COLS))


@query("C05b_extend_loop_warming", _loop_sql(True))
def _(v):
    return rounded(sn.extend_loop(v.mon, (1997, 2000), 2001, 2010, _trends(v)).select(*_COLS))


@query("C06_replace_history", f"""select e.glacier_id, e.gcm, e.ssp, e.yr, e.mo, {R('case when e.yr < 1999 and m.temp is not null then m.temp else e.temp end')} as temp,
  {R('case when e.yr < 1999 and m.prcp is not null then m.prcp else e.prcp end')} as prcp
from ens e left join mon m on e.glacier_id = m.glacier_id and e.yr = m.yr and e.mo = m.mo""")
def _(v):
    return rounded(sn.replace_history(v.ens, v.mon, 1999).select(*MEMBER, "yr", "mo", "temp", "prcp"))


@query("C07_yearly_amplify", f"""with m as (select *, avg(temp) over (partition by glacier_id, gcm, ssp, yr) as mt from ens)
select glacier_id, gcm, ssp, yr, mo, {R('case when yr >= 1999 and temp < mt then mt + (temp - mt) * 1.4e0 else temp end')} as temp, {R('prcp')} as prcp from m""")
def _(v):
    return rounded(sn.yearly_amplify(v.ens, 1.4, 1999))


@query("C08_combine_hist_future", f"""select glacier_id, gcm, ssp, yr, mo, {R('case when yr <= 1998 then temp else temp + 1 end')} as temp, {R('prcp')} as prcp from ens""")
def _(v):
    hist, fut = v.ens.where(F.col("yr") <= 1998), v.ens.where(F.col("yr") >= 1997).withColumn("temp", F.col("temp") + 1)
    return rounded(sn.combine_hist_future(hist, fut))


@query("C09_ensemble_mean_member", f"""with a as (select glacier_id, gcm, ssp, yr, avg(temp) / 10e0 as t, avg(prcp) - 100e0 as p from ens group by 1, 2, 3, 4),
m as (select glacier_id, yr, avg(t) as t, avg(p) as p from a group by 1, 2),
c as (select glacier_id, mo, avg(temp) as t, avg(prcp) as p from mon where yr between 1996 and 1999 group by 1, 2)
select m.glacier_id, m.yr, c.mo, {R('c.t + m.t')} as temp, {R('greatest(c.p + m.p, 0)')} as prcp from m join c on m.glacier_id = c.glacier_id""")
def _(v):
    runs = v.ens.groupBy(*MEMBER, "yr").agg((F.avg("temp") / 10.0).alias("temp"), (F.avg("prcp") - 100.0).alias("prcp"))
    return rounded(sn.ensemble_mean_member(runs, v.mon, 1996, 1999))


# ---- T: robust trends

def _monthly_dh(v):
    month = F.trunc("obs_date", "month")
    return v.fp.where(F.abs("dh") < 150).groupBy("region22", month.alias("month")).agg(
        F.avg("dh").alias("dh"), F.count("*").alias("n")
    ).withColumn("day", F.date_diff("month", F.lit("1995-01-01").cast("date")).cast("double"))


@query("T01_robust_trend_bisquare", trend_sql.BISQUARE)
def _(v):
    return rounded(tr.robust_trend_bisquare(_monthly_dh(v), ["region22"], "day", "dh"))


@query("T02_robust_trend_huber", trend_sql.HUBER)
def _(v):
    return rounded(tr.robust_trend_huber(_monthly_dh(v), ["region22"], "day", "dh", min_count=10))


@query("T03_seasonal_trend")
def _(v):
    return rounded(_trended(v.mon, ["glacier_id"]))


@query("T03b_seasonal_trend_robust")
def _(v):
    return rounded(tr.seasonal_trend(v.mon, ["glacier_id"], ["yr", "mo"], ["temp"], period=12, trend=25, seasonal=13, robust=True))
