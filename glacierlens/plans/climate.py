"""Queries on daily and monthly climate."""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.functions import regression as reg
from glacierlens.operators import climate as cl
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R
from glacierlens.sources import reshape

YEARS = list(range(1995, 2002))


@query(
    "A20_daily_to_monthly",
    f"""select glacier_id, variable, cast(date_trunc('month', obs_date) as date) as month,
  {R('avg(value)')} as value, count(value) as n_days from dly where variable in ('A', 'R') group by 1, 2, 3""",
)
def _(v):
    return rounded(cl.daily_to_monthly(v.dly, ["A", "R", "unknown"]))


@query(
    "A20b_empty_months",
    """select glacier_id, variable, cast(date_trunc('month', obs_date) as date) as month
from dly group by 1, 2, 3 having count(value) = 0""",
)
def _(v):
    return cl.empty_months(cl.daily_to_monthly(v.dly))


@query(
    "A21_anomalies",
    f"""select glacier_id, yr, mo, {R('temp - avg(temp) over (partition by glacier_id)')} as anomaly from mon""",
)
def _(v):
    return rounded(cl.anomalies(v.mon, "temp").select("glacier_id", "yr", "mo", "anomaly"))


@query(
    "A22_glacier_quantiles",
    "select glacier_id, "
    + ", ".join(f"{R(f'quantile_cont(temp, {p / 100})')} as p{p}" for p in (1, 5, 10, 90, 95, 99))
    + " from mon group by 1",
)
def _(v):
    return rounded(cl.glacier_quantiles(v.mon, "temp", (1, 5, 10, 90, 95, 99)))


_SCORED = """with a as (select *, temp - avg(temp) over (partition by glacier_id) as ta,
  prcp - avg(prcp) over (partition by glacier_id) as pa from mon),
q as (select glacier_id, quantile_cont(ta, 0.99) as t99, quantile_cont(ta, 0.95) as t95, quantile_cont(ta, 0.9) as t90,
  quantile_cont(pa, 0.01) as p01, quantile_cont(pa, 0.05) as p05, quantile_cont(pa, 0.1) as p10 from a group by 1),
s as (select a.glacier_id, yr, mo,
  case when ta >= t99 then 4e0 when ta >= t95 then 2e0 when ta >= t90 then 1e0 else 0e0 end as ts,
  case when pa <= p01 then 2e0 when pa <= p05 then 1e0 when pa <= p10 then 0.5e0 else 0e0 end as ps
  from a join q on a.glacier_id = q.glacier_id)
"""


def _temp_scores(v):
    return cl.score_temperature(cl.anomalies(v.mon, "temp"))


def _prcp_scores(v):
    return cl.score_precipitation(cl.anomalies(v.mon, "prcp"))


@query("A23_score_temperature", _SCORED + "select glacier_id, yr, mo, ts as score from s")
def _(v):
    return _temp_scores(v).select("glacier_id", "yr", "mo", "score")


@query("A23b_score_precipitation", _SCORED + "select glacier_id, yr, mo, ps as score from s")
def _(v):
    return _prcp_scores(v).select("glacier_id", "yr", "mo", "score")


@query("A24_annual_scores", _SCORED + "select glacier_id, yr, sum(ts) as score from s group by 1, 2")
def _(v):
    return cl.annual_scores(_temp_scores(v))


@query(
    "A25_compound_scores",
    _SCORED + """select glacier_id, yr, sum(case when yr <= 2000 then ts end) as temp_score,
  sum(case when yr >= 1996 then ps end) as prcp_score,
  sum(case when yr <= 2000 then ts end) + sum(case when yr >= 1996 then ps end) as score from s group by 1, 2""",
)
def _(v):
    # the two sheets cover different years, so both sides have gaps
    t = cl.annual_scores(_temp_scores(v)).where(F.col("yr") <= 2000)
    p = cl.annual_scores(_prcp_scores(v)).where(F.col("yr") >= 1996)
    return cl.compound_scores(t, p)


@query(
    "A26_period_difference",
    f"""select glacier_id, {R('avg(case when yr between 1995 and 1997 then prcp end) * 365000e0', 3)} as early,
  {R('avg(case when yr between 1999 and 2001 then prcp end) * 365000e0', 3)} as recent,
  {R('(avg(case when yr between 1999 and 2001 then prcp end) * 365000e0) - (avg(case when yr between 1995 and 1997 then prcp end) * 365000e0)', 3)}
    as difference from mon group by 1""",
)
def _(v):
    return rounded(cl.period_difference(v.mon, "prcp", (1995, 1997), (1999, 2001), 365000.0), 3)


_GRID = f"""with m as (select glacier_id, avg(temp) as t from mon group by 1)
select floor(cen_lon) as cell_lon, floor(cen_lat) as cell_lat, floor(cen_lon) + 0.5e0 as center_lon,
  floor(cen_lat) + 0.5e0 as center_lat, {R('sum(area_km2)')} as area_km2, {R('avg(m.t)')} as value,
  count(*) as n_glaciers
from gl left join m on gl.region22 = m.glacier_id group by 1, 2, 3, 4"""


@query("A27_grid_aggregate", _GRID)
def _(v):
    means = v.mon.groupBy(F.col("glacier_id").alias("region22")).agg(F.avg("temp").alias("t"))
    return rounded(cl.grid_aggregate(cl.attach_series(v.gl, means, "region22"), "t"))


@query(
    "J12_attach_series",
    f"""with m as (select glacier_id, avg(temp) as t from mon where glacier_id < 20 group by 1)
select gl.glacier_id, name, region22, {R('area_km2')} as area_km2, {R('m.t')} as value
from gl left join m on gl.region22 = m.glacier_id""",
)
def _(v):
    # some regions have no series, to show the left join
    means = v.mon.where(F.col("glacier_id") < 20).groupBy(F.col("glacier_id").alias("region22")).agg(
        F.avg("temp").alias("value")
    )
    out = cl.attach_series(v.gl, means, "region22")
    return rounded(out.select("glacier_id", "name", "region22", "area_km2", "value"))


@query(
    "A28_yearly_distribution",
    f"""select cast(year(obs_date) as int) as yr, count(value) as n, {R('avg(value)')} as mean, {R('median(value)')} as median,
  {R('quantile_cont(value, 0.25)')} as q25, {R('quantile_cont(value, 0.75)')} as q75 from dly group by 1""",
)
def _(v):
    return rounded(cl.yearly_distribution(v.dly.withColumn("yr", F.year("obs_date")), "value"))


@query(
    "A38_annual_pdd",
    f"""select glacier_id, yr, {R('sum(greatest(temp, 0))')} as pdd, {R('sum(prcp)')} as prcp from mon group by 1, 2""",
)
def _(v):
    return rounded(cl.annual_pdd(v.mon))


_WINTER = """select glacier_id, count(prcp) as n_months, case when count(prcp) = 35 then
  avg(prcp / day(last_day(make_date(yr, mo, 1)))) end as w
from mon where yr between 1996 and 2000 and mo in ({}) group by 1"""


@query(
    "A46_winter_prcp_factor",
    f"""select glacier_id, n_months, {R('w')} as winter_prcp,
  {R('case when w is null then null when w = 0 then 10e0 else least(greatest(-1.0614e0 * ln(w) + 3.92e0, 0.1e0), 10e0) end')} as factor from ({_WINTER.format('10, 11, 12, 1, 2, 3, 4')})""",
)
def _(v):
    w = cl.winter_daily_prcp(v.mon, 1996, 2000)
    return rounded(w.withColumn("factor", cl.winter_prcp_factor(F.col("winter_prcp"))))


@query(
    "A46b_winter_prcp_south",
    f"select glacier_id, n_months, {R('w')} as winter_prcp from ({_WINTER.format('4, 5, 6, 7, 8, 9, 10')})",
)
def _(v):
    return rounded(cl.winter_daily_prcp(v.mon, 1996, 2000, southern=True))


_TOP = """select glacier_id, yr, score, rn as rank from (select *,
  cast(row_number() over (partition by glacier_id order by score desc, yr) as int) as rn,
  count(*) over (partition by glacier_id) as n from scores where score is not null)
where n >= 5 and rn <= 5"""


@query("W08_top_n_years", _TOP)
def _(v):
    return cl.top_n_years(v.scores, 5)


@query("K03_top5_per_glacier", _TOP)
def _(v):
    return cl.top_n_years(v.scores, 5)


@query(
    "W08b_period_share",
    f"""select cast(floor((yr - 1995) / 5e0) * 5 + 1995 as int) as period_start, count(*) as n,
  {R('count(*) / cast(sum(count(*)) over () as double)')} as share from ({_TOP}) group by 1""",
)
def _(v):
    return rounded(cl.period_share(cl.top_n_years(v.scores, 5), 1995))


T_TEST = """m as (select {k}, regr_count(y, x) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, corr(y, x) as r,
  regr_syy(y, x) as syy, regr_sxx(y, x) as sxx from src group by all),
tt as (select *, n - 2 as nu, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2)) as th from m),
pv as (select {k}, case when any_value(nu) % 2 = 0 then
    1 - sin(any_value(th)) * sum(case when i <= nu / 2 - 1 then exp(lgamma(i + 0.5e0) - lgamma(0.5e0) - lgamma(i + 1e0)) * pow(cos(th), 2 * i) else 0 end)
  else 1 - 2 / pi() * (any_value(th) + sin(any_value(th)) * cos(any_value(th))
    * sum(case when i <= (nu - 3) / 2 then exp(lgamma(i + 1e0) + lgamma(1.5e0) - lgamma(i + 1.5e0)) * pow(cos(th), 2 * i) else 0 end)) end as p
  from tt, (select unnest(generate_series(0, 100)) as i) where nu > 0 group by {k})"""


def trend_sql(src: str, keys: str) -> str:
    on = " and ".join(f"t.{k} = p.{k}" for k in keys.split(", "))
    ks = ", ".join(f"t.{k}" for k in keys.split(", "))
    return f"""with src as ({src}), {T_TEST.format(k=keys)}
select {ks}, n, {R('slope')} as slope, {R('intercept')} as intercept, {R('r')} as r, {R('p.p')} as p,
  {R('sqrt((1 - r * r) * syy / sxx / (n - 2))')} as stderr from tt t left join pv p on {on}"""


@query("T04_linear_trend", trend_sql("select glacier_id, yr as x, score as y from scores", "glacier_id"))
def _(v):
    return rounded(reg.linear_trend(v.scores, ["glacier_id"], "yr", "score"))


@query("T06_monthly_warming_trends", trend_sql("select glacier_id, mo, yr as x, temp as y from mon", "glacier_id, mo"))
def _(v):
    return rounded(reg.linear_trend(v.mon, ["glacier_id", "mo"], "yr", "temp"))


_WIDE = ", ".join(f"max(case when yr = {y} then score end) as \"{y}\"" for y in YEARS)


@query("S05_long_to_wide", f"select glacier_id, {_WIDE} from scores group by 1")
def _(v):
    return reshape.long_to_wide(v.scores, "glacier_id", "yr", "score", YEARS)


@query("S04_wide_to_long", "select glacier_id, cast(yr as varchar) as period, score as value from scores where score is not null")
def _(v):
    wide = reshape.long_to_wide(v.scores, "glacier_id", "yr", "score", YEARS)
    return reshape.wide_to_long(wide, "glacier_id")


@query(
    "S13_select_series",
    f"""select variable, {R('avg(value)')} as value, count(value) as n from dly
where variable = 'N' and glacier_id between 3 and 8 and obs_date >= date '1996-03-01' and obs_date <= date '1999-06-30'
group by 1""",
)
def _(v):
    from glacierlens.sources.scans import select_series

    out = select_series(
        v.dly, variable="N", glacier=F.col("glacier_id").between(3, 8), t0="1996-03-01", t1="1999-06-30", by=["variable"]
    )
    return rounded(out)
