"""DuckDB text of robust lines: the iteration is a recursive query, inference comes from closed forms."""

from __future__ import annotations

from glacierlens.plans.sqltext import R

_MONTHLY = """(select region22 as k, cast(date_diff('day', date '1995-01-01', cast(date_trunc('month', obs_date) as date)) as double) as x,
  avg(dh) as y, count(*) as c from fp where abs(dh) < 150 group by 1, 2)"""

# one row for each series that is long enough, with its plain line
_SERIES = """m as (select k, count(*) as n, avg(x) as mx, var_pop(x) * count(*) as sxx, stddev_samp(y) as sd, regr_slope(y, x) as b, regr_intercept(y, x) as a
  from src group by 1 having count(*) >= 10 and var_pop(x) > 0),
pnt as (select s.k, s.x, s.y, n, mx, sxx, m.a as a0, m.b as b0, coalesce(nullif(1e-6 * sd, 0), 1) as tiny,
  least(1e0 / n + (s.x - mx) * (s.x - mx) / sxx, 0.9999e0) as h from src s join m on s.k = m.k)"""

# weighted line from sums around the series' mean
_LINE = """select *, (sy - b1 * sx) / sw - b1 * mx as a1 from (select *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) as b1 from (
  select {keys}, any_value(mx) as mx, sum(w) as sw, sum(w * (x - mx)) as sx, sum(w * y) as sy, sum(w * (x - mx) * (x - mx)) as sxx, sum(w * (x - mx) * y) as sxy,
    count(*) filter (w > 0) as held from ({rows}) group by all))"""


def _rel(new: str, old: str) -> str:
    return f"abs({new} - {old}) / greatest(abs({new}), abs({old}), 1e-300)"


def _bisquare(u: str) -> str:
    return f"case when abs({u}) < 1 then pow(1 - ({u}) * ({u}), 2) else 0e0 end"


# two-sided p-value of Student's t = tan(th) sqrt(nu), as a sum over rows of i for each group of one th and nu
_STUDENT = """case when any_value(nu) % 2 = 0 then
    1 - sin(any_value(th)) * sum(case when i <= nu / 2 - 1 then exp(lgamma(i + 0.5e0) - lgamma(0.5e0) - lgamma(i + 1e0)) * pow(cos(th), 2 * i) else 0 end)
  else 1 - 2 / pi() * (any_value(th) + sin(any_value(th)) * cos(any_value(th))
    * sum(case when i <= (nu - 3) / 2 then exp(lgamma(i + 1e0) + lgamma(1.5e0) - lgamma(i + 1.5e0)) * pow(cos(th), 2 * i) else 0 end)) end"""


_SCALE = "list_aggregate(list_slice(list_sort(list(abs({r})) over (partition by k)), 2, n), 'median') / 0.6745e0"

BISQUARE = f"""with recursive src as {_MONTHLY}, {_SERIES},
it as (select k, 0 as i, a, b, false as done from m
  union all
  select k, i + 1, case when held < 2 then a else a1 end, case when held < 2 then b else b1 end,
    held < 2 or greatest({_rel('a1', 'a')}, {_rel('b1', 'b')}) <= 1.5e-8
  from ({_LINE.format(keys='k, i, a, b', rows=f'''select *, {_bisquare('r / (s * 4.685e0)')} as w from (
      select *, greatest({_SCALE.format(r='r')}, tiny) as s from (
        select p.*, i, a, b, (p.y - a - b * p.x) / sqrt(1 - h) as r from it join pnt p on it.k = p.k where not done and i < 50))''')})),
line as (select k, arg_max(a, i) as a, arg_max(b, i) as b from it group by 1),
res as (select p.*, l.a, l.b, (p.y - l.a - l.b * p.x) / sqrt(1 - h) as r, p.y - a0 - b0 * p.x as plain from pnt p join line l on p.k = l.k),
scaled as (select *, greatest({_SCALE.format(r='r')}, tiny) * 4.685e0 as st from res),
pseudo as (select k, any_value(n) as n, any_value(sxx) as sxx, any_value(st) as st, any_value(a) as a, any_value(b) as b, sqrt(sum(plain * plain) / (any_value(n) - 2)) as ols,
  avg(((r / st + 1e-4) * {_bisquare('r / st + 1e-4')} - (r / st - 1e-4) * {_bisquare('r / st - 1e-4')}) / 2e-4) as m1,
  sum((1 - h) * pow(r / st * {_bisquare('r / st')}, 2)) / (any_value(n) - 2) as m2 from scaled group by 1),
robust as (select *, case when m1 > 0 then (1 + 2e0 / n * (1 - m1) / m1) * sqrt(m2) * st / m1 else ols end as rs from pseudo),
err as (select *, greatest(rs, sqrt((ols * ols * 4 + rs * rs * n) / (4 + n))) / sqrt(sxx) as se, n - 2 as nu from robust),
terms as (select unnest(generate_series(0, 100)) as i),
pv as (select k, {_STUDENT} as p
  from (select *, atan(abs(b / se) / sqrt(nu)) as th from err where se > 0), terms group by 1),
quant as (select distinct nu, 0 as step, 1e0 as lo, 20e0 as hi from err
  union all
  select nu, step + 1, case when p > 0.05 then mid else lo end, case when p > 0.05 then hi else mid end from (
    select nu, step, any_value(lo) as lo, any_value(hi) as hi, any_value(mid) as mid, {_STUDENT} as p
    from (select *, (lo + hi) / 2 as mid, atan((lo + hi) / 2 / sqrt(nu)) as th from quant where step < 60), terms group by nu, step)),
q as (select nu, arg_max((lo + hi) / 2, step) as t from quant group by 1),
every as (select k, count(*) as n from src group by 1)
select e.k as region22, e.n, {R('r.b')} as slope, {R('r.a')} as intercept, {R('case when r.se = 0 then 0e0 else p.p end')} as p, {R('q.t * r.se')} as half_ci
from every e left join err r on e.k = r.k left join pv p on e.k = p.k left join q on r.nu = q.nu"""


_MAD = "list_aggregate(list(abs({r})) over (partition by k{more}), 'median') / 0.6744897501960817e0"


def _cost(z: str) -> str:
    return f"case when abs({z}) <= 1.345e0 then ({z}) * ({z}) / 2 else 1.345e0 * abs({z}) - 1.345e0 * 1.345e0 / 2 end"


# complementary error function: Abramowitz & Stegun's series is too coarse, so the series of erf and the fraction of erfc
_NORMAL = """norm as (select k, z, case when z < 3 then 1 - 2 / sqrt(pi()) * sum(case when i % 2 = 0 then 1 else -1 end * exp((2 * i + 1) * ln(greatest(z, 1e-300)) - lgamma(i + 1e0)) / (2 * i + 1))
    else 0e0 end as small from (select k, abs(b / se) / sqrt(2e0) as z from err where se > 0), (select unnest(generate_series(0, 80)) as i) group by 1, 2),
frac as (select k, z, 60 as j, z as f from norm where z >= 3 union all select k, z, j - 1, z + j / 2e0 / f from frac where j > 0),
pv as (select n.k, case when n.z < 3 then small else exp(-n.z * n.z) / sqrt(pi()) / f end as p from norm n left join (select k, f from frac where j = 0) t on n.k = t.k)"""

HUBER = f"""with recursive raw as (select * from {_MONTHLY} where c >= 10 and y <> 0),
w as (select *, list(y) over (partition by k order by x rows between 5 preceding and 5 following) as l from raw),
wm as (select *, list_aggregate(l, 'median') as med from w),
wd as (select *, list_aggregate(list_transform(l, lambda v: abs(v - med)), 'median') as mad from wm),
src as (select k, x, case when abs(y - med) > 3 * 1.4826e0 * mad then med else y end as y from wd), {_SERIES},
it as (select k, 0 as i, a, b, cast(null as double) as dev, false as done from m
  union all
  select k, i + 1, any_value(case when stuck then a else a1 end), any_value(case when stuck then b else b1 end), sum({_cost('r1 / nullif(s1, 0)')}),
    bool_or(stuck) or any_value(s1) <= 0 or coalesce(abs(sum({_cost('r1 / nullif(s1, 0)')}) - any_value(dev)) <= 1e-8, false)
  from (select *, {_MAD.format(r='r1', more=', i')} as s1 from (
    select l.*, p.y - l.a1 - l.b1 * p.x as r1 from (
      select *, coalesce(any_s, 0) <= 0 as stuck from ({_LINE.format(keys='k, i, a, b, dev, s as any_s', rows=f'''
        select *, case when abs(r) <= 1.345e0 * s then 1e0 else 1.345e0 * s / nullif(abs(r), 0) end as w from (
          select *, {_MAD.format(r='r', more='')} as s from (
            select p.*, i, a, b, dev, p.y - a - b * p.x as r from it join pnt p on it.k = p.k where not done and i < 50))''')})) l join pnt p on l.k = p.k)) group by k, i),
line as (select k, arg_max(a, i) as a, arg_max(b, i) as b from it group by 1),
res as (select p.*, l.a, l.b, p.y - l.a - l.b * p.x as r from pnt p join line l on p.k = l.k),
scaled as (select *, {_MAD.format(r='r', more='')} as s from res),
parts as (select k, any_value(n) as n, any_value(sxx) as sxx, any_value(s) as s, any_value(a) as a, any_value(b) as b,
  avg(case when abs(r / s) <= 1.345e0 then 1e0 else 0e0 end) as inner_share, sum(pow(least(greatest(r / s, -1.345e0), 1.345e0), 2)) as squares from scaled group by 1),
err as (select *, case when s <= 0 then 0e0 else sqrt(pow(1 + 2e0 / n * (1 - inner_share) / inner_share, 2) * squares * s * s / (n - 2) / (inner_share * inner_share) / sxx) end as se from parts),
{_NORMAL},
every as (select k, count(*) as n from src group by 1)
select e.k as region22, e.n, {R('r.b')} as slope, {R('r.a')} as intercept, {R('case when r.se = 0 then 0e0 else p.p end')} as p, {R('1.959963984540054e0 * r.se')} as half_ci
from every e left join err r on e.k = r.k left join pv p on e.k = p.k"""
