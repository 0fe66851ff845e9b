"""Queries on temperature-index mass balance (M, A45, A53, A54, W17, W18, W22, W23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.operators import balance as mb
from glacierlens.operators import series as se
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R
from glacierlens.sources import reshape


def _points(v):
    return mb.climate_on_height(v.mon, v.par, v.bins)


@query("M01_climate_on_height", f"""select glacier_id, bin_id, yr, mo, {R('temp')} as temp, {R('prcp')} as prcp, {R('melt')} as melt, {R('snow')} as snow from pt""")
def _(v):
    return rounded(_points(v).select("glacier_id", "bin_id", "yr", "mo", "temp", "prcp", "melt", "snow"))


@query("M01b_climate_local_gradient", f"""with g as (select m.glacier_id, m.yr, m.mo, b.bin_id, m.prcp * 2.5e0 as p,
  m.temp + least(greatest(case when mo % 4 = 0 then -0.0065e0 else mo * -0.0012e0 end, -0.009e0), -0.003e0) * (b.height - p.ref_hgt) as t
  from mon m join par p on m.glacier_id = p.glacier_id join bins b on m.glacier_id = b.glacier_id)
select glacier_id, yr, mo, {R('avg(t)')} as temp, {R('avg(case when t <= -1 then 0 else t + 1 end)')} as melt,
  {R('avg(p * case when t <= 0 then 1 when t >= 2 then 0 else 1 - t / 2e0 end)')} as snow from g group by 1, 2, 3""")
def _(v):
    clim = v.mon.withColumn("gradient", F.when(F.col("mo") % 4 != 0, F.col("mo") * -0.0012))
    pts = mb.climate_on_height(clim, v.par, v.bins)
    return rounded(pts.groupBy("glacier_id", "yr", "mo").agg(*[F.avg(c).alias(c) for c in ("temp", "melt", "snow")]))


@query("M02_yearly_climate", f"""select glacier_id, bin_id, height, yr, {R('sum(melt)')} as melt, {R('sum(snow)')} as snow from pt
group by 1, 2, 3, 4 having count(melt + snow) = 12""")
def _(v):
    return rounded(mb.yearly_climate_on_height(_points(v)))


@query("M02b_yearly_climate_flat", f"""with f as (select glacier_id, yr, mo, avg(melt) as melt, avg(snow) as snow from pt group by 1, 2, 3)
select glacier_id, yr, {R('sum(melt)')} as melt, {R('sum(snow)')} as snow from f group by 1, 2 having count(melt + snow) = 12""")
def _(v):
    return rounded(mb.yearly_climate_on_height(_points(v), flatten=True))


_GC = """y as (select glacier_id, bin_id, width, yr, sum(melt) as melt, sum(snow) as snow from pt group by 1, 2, 3, 4 having count(melt + snow) = 12),
gc as (select glacier_id, yr, sum(width * melt) / sum(width) as temp, sum(width * snow) / sum(width) as prcp from y group by 1, 2)"""


@query("M03_glacier_climate", f"with {_GC} select glacier_id, yr, {R('temp')} as temp, {R('prcp')} as prcp from gc")
def _(v):
    return rounded(mb.glacier_climate(v.mon, v.par, v.bins))


@query("M04_point_balance_monthly", f"select glacier_id, bin_id, yr, mo, {R('snow - mu * melt - bias / 12e0')} as mb from pt")
def _(v):
    return rounded(mb.point_balance(_points(v)).select("glacier_id", "bin_id", "yr", "mo", "mb"))


@query("M04b_point_balance_annual", f"""select glacier_id, bin_id, yr, {R('sum(snow) - any_value(mu) * sum(melt) - any_value(bias)')} as mb from pt
group by 1, 2, 3 having count(melt + snow) = 12""")
def _(v):
    return rounded(mb.point_balance(_points(v), annual=True).select("glacier_id", "bin_id", "yr", "mb"))


@query("M05_linear_balance", f"""select b.glacier_id, b.bin_id, {R('least((b.height - (p.ref_hgt + 75e0)) * 3e0, 1500e0)')} as mb
from bins b join par p on b.glacier_id = p.glacier_id""")
def _(v):
    ela = v.par.select("glacier_id", F.col("ref_hgt").alias("ela"))
    return rounded(mb.linear_balance(v.bins, ela, 3.0, 1500.0, temp_bias=0.5).select("glacier_id", "bin_id", "mb"))


_SMB = f"{_GC}, smb as (select gc.glacier_id, yr, prcp - mu * temp - bias as mb from gc join par on gc.glacier_id = par.glacier_id)"


@query("M06_specific_mb", f"with {_SMB} select glacier_id, yr, {R('mb', 5)} as mb from smb")
def _(v):
    return rounded(mb.specific_mb(v.mon, v.par, v.bins), 5)


@query("M07_constant_climate", f"""with m as (select glacier_id, bin_id, mo, any_value(mu) as mu, any_value(bias) as bias, avg(temp) as temp, avg(melt) as melt, avg(snow) as snow
  from pt where yr between 1996 and 2000 group by 1, 2, 3)
select glacier_id, bin_id, {R('avg(temp)')} as temp, {R('sum(melt)')} as melt, {R('sum(snow)')} as snow,
  {R('sum(snow) - any_value(mu) * sum(melt) - any_value(bias)', 5)} as mb from m group by 1, 2""")
def _(v):
    out = mb.constant_climate_balance(v.mon, v.par, v.bins, 1998, 2)
    return rounded(out.select("glacier_id", "bin_id", "temp", "melt", "snow", F.round(F.col("mb") + 1.3e-7, 5).alias("mb")))


@query("M07b_mean_climate_balance", f"""with c as (select glacier_id, mo, avg(temp) as temp, avg(prcp) * 2.5e0 as p from mon where yr between 1996 and 2000 group by 1, 2),
q as (select c.glacier_id, b.bin_id, par.mu, par.bias, c.p, c.temp - 0.0065e0 * (b.height - par.ref_hgt) as t
  from c join par on c.glacier_id = par.glacier_id join bins b on b.glacier_id = c.glacier_id)
select glacier_id, bin_id, {R('sum(p * least(greatest(1 - t / 2e0, 0), 1)) - any_value(mu) * sum(greatest(t + 1, 0)) - any_value(bias)', 5)} as mb from q group by 1, 2""")
def _(v):
    out = mb.constant_climate_balance(v.mon, v.par, v.bins, 1998, 2, mean_first=True)
    return rounded(out.select("glacier_id", "bin_id", "mb"), 5)


def _ela_sql(keys: str, months: str, years: int) -> str:
    """Kinks of the piecewise linear balance, its values there, the crossing piece."""
    k = f"glacier_id{keys}"
    using = f"using (glacier_id{keys})"
    return f"""ms as ({months}),
ok as (select {k} from ms group by {k} having count(temp + p) = {12 * years}),
z as (select distinct {k}, z from (
  select {k}, ref_hgt + (l.lim - temp) / -0.0065e0 as z from ms, (values (-1e0), (0e0), (2e0)) l(lim)
  union all select {k}, -1e4 from ok union all select {k}, 2e4 from ok) where z between -1e4 and 2e4),
b as (select {", ".join("z." + c for c in k.split(", "))}, z.z, sum(p * least(greatest(1 - (temp - 0.0065e0 * (z.z - ref_hgt)) / 2e0, 0), 1)
    - mu * greatest(temp - 0.0065e0 * (z.z - ref_hgt) + 1, 0)) / {years}e0 - any_value(bias) as b
  from z join ms {using} join ok {using} group by all),
n as (select *, lead(z) over (partition by {k} order by z) as z1, lead(b) over (partition by {k} order by z) as b1 from b),
ela as (select {k}, max(case when z = -1e4 and b > 0 then 1 when z = 2e4 and b < 0 then 1 else 0 end) as bad,
  coalesce(arg_max(z + (z1 - z) * (-b) / (b1 - b), z) filter (where b < 0 and z1 is not null), -1e4) as ela from n group by {k})"""


_MS = "select m.glacier_id, m.yr, m.temp, m.prcp * 2.5e0 as p, ref_hgt, mu, bias from mon m join par on m.glacier_id = par.glacier_id"


@query("M08_ela", f"with {_ela_sql(', yr', _MS, 1)} select glacier_id, yr, {R('case when bad = 0 then ela end', 4)} as ela from ela")
def _(v):
    return rounded(mb.equilibrium_line(v.mon, v.par), 4)


@query("M08b_ela_of_flowlines", f"""with {_ela_sql(', yr', _MS, 1)}, e as (select glacier_id, yr, case when bad = 0 then ela end as ela from ela),
f as (select e.*, f.flowline, ela + f.flowline * 10e0 as fe, a.area from e, (values (0), (1)) f(flowline)
  join (select glacier_id, cast(bin_id % 2 as int) as flowline, sum(width) as area from bins group by 1, 2) a on a.glacier_id = e.glacier_id and a.flowline = f.flowline)
select glacier_id, yr, {R('sum(fe * area) / sum(area)', 4)} as ela from f group by 1, 2""")
def _(v):
    one = mb.equilibrium_line(v.mon, v.par)
    both = one.withColumn("flowline", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ela", F.col("ela") + F.col("flowline") * 10.0)
    areas = v.bins.groupBy("glacier_id", (F.col("bin_id") % 2).cast("int").alias("flowline")).agg(F.sum("width").alias("area"))
    return rounded(mb.ela_of_flowlines(both, areas), 4)


@query("M09_random_climate_balance", f"""with {_SMB},
sim as (select cast(2000 + i as int) as sim_year, i // 6 as cycle, i % 6 as pos from (select unnest(generate_series(0, 49)) as i)),
pool as (select cycle, y, row_number() over (partition by cycle order by md5('7-' || cycle || '-' || y)) - 1 as pos
  from (select distinct cycle from sim), (select unnest(generate_series(1995, 2000)) as y)),
map as (select sim_year, cast(y as int) as yr from sim join pool on sim.cycle = pool.cycle and sim.pos = pool.pos)
select glacier_id, sim_year, smb.yr, {R('mb', 5)} as mb from smb join map on smb.yr = map.yr""")
def _(v):
    years = mb.random_years(v.spark, 2000, 50, list(range(1995, 2001)), seed=7)
    return rounded(mb.random_climate_balance(mb.specific_mb(v.mon, v.par, v.bins), years), 5)


def _u(name, part):
    return f"(cast('0x' || substr(md5('11-{name}-{part}-' || yr), 1, 8) as bigint) + 0.5e0) / 4294967296e0"


def _z(name):
    return f"sqrt(-2e0 * ln({_u(name, 'a')})) * cos(2e0 * pi() * {_u(name, 'b')})"


@query("M10_perturbed_balance", f"""with q as (select m.glacier_id, m.yr, m.mo, b.width, p.mu, p.bias,
  m.temp + 0.1e0 * ({_z('temp')}) - 0.0065e0 * (b.height - p.ref_hgt) as t, m.prcp * (2.5e0 + 0.1e0 * ({_z('prcp')})) as p
  from mon m join par p on m.glacier_id = p.glacier_id join bins b on b.glacier_id = m.glacier_id),
g as (select glacier_id, yr, any_value(mu) as mu, any_value(bias) as bias, count(distinct mo) as n,
  sum(width * greatest(t + 1, 0)) / sum(width) * 12 as melt, sum(width * p * least(greatest(1 - t / 2e0, 0), 1)) / sum(width) * 12 as snow from q group by 1, 2)
select glacier_id, yr, {R(f"snow - mu * melt - bias - 100e0 * ({_z('bias')})", 5)} as mb from g where n = 12""")
def _(v):
    return rounded(mb.perturbed_balance(v.mon, v.par, v.bins, seed=11), 5)


_REF = "ref as (select glacier_id, -200e0 + glacier_id * 20e0 as ref_mb from par)"


@query("M11_calibrate_mu", f"""with {_REF}, ks as (select cast(unnest(generate_series(-199, 199)) as int) as k),
q as (select m.glacier_id, ks.k, b.width, m.temp - 0.0065e0 * (b.height - (p.ref_hgt + 25e0 * ks.k)) as t, m.prcp * 2.5e0 as p
  from mon m join par p on m.glacier_id = p.glacier_id
  join (select glacier_id, height, sum(width) as width from bins group by 1, 2) b on b.glacier_id = m.glacier_id, ks where m.yr between 1996 and 2000),
r as (select glacier_id, k, sum(width * greatest(t + 1, 0)) / sum(width) * 12 as tm, sum(width * p * least(greatest(1 - t / 2e0, 0), 1)) / sum(width) * 12 as pm from q group by 1, 2),
c as (select r.glacier_id, k, ref_mb, (pm - ref_mb) / nullif(tm, 0) as mu, pm - 75e0 * tm - ref_mb as low from r join ref on r.glacier_id = ref.glacier_id),
s as (select c.*, case when c0.low < 0 then -1 else 1 end as sign from c join (select glacier_id, low from c where k = 0) c0 on c.glacier_id = c0.glacier_id),
f as (select glacier_id, arg_min(mu, abs(k)) as mu, arg_min(k, abs(k)) as k from s where mu between 75 and 500 and k * sign >= 0 group by 1)
select ref.glacier_id, ref_mb, {R('f.mu')} as mu, par.ref_hgt + 25e0 * f.k as calib_hgt, 25e0 * f.k as hgt_change
from ref join par on ref.glacier_id = par.glacier_id left join f on f.glacier_id = ref.glacier_id""")
def _(v):
    ref = v.par.select("glacier_id", (-200.0 + F.col("glacier_id") * 20.0).alias("ref_mb"))
    return rounded(mb.calibrate_mu(v.mon, v.par, v.bins, ref, 1996, 2000))


@query("M12_climate_qc", """with w as (select glacier_id, yr, temp, row_number() over (partition by glacier_id, yr order by temp desc) as d,
  row_number() over (partition by glacier_id, yr order by temp) as a from mon),
e as (select glacier_id, min(height) as bot, max(height) as top from bins group by 1),
x as (select w.glacier_id, min(temp) filter (where d = 4) as warm, max(temp) filter (where a = 4) as cold from w group by 1),
j as (select x.glacier_id, p.ref_hgt, -1e0 - warm + 0.0065e0 * (bot - p.ref_hgt) as miss, cold - 0.0065e0 * (top - p.ref_hgt) - 1e0 as over
  from x join e on x.glacier_id = e.glacier_id join par p on p.glacier_id = x.glacier_id),
s as (select *, case when miss >= 0 then (floor(miss / 0.065e0) + 1) * 10e0 when over >= 0 then -(floor(over / 0.065e0) + 1) * 10e0 else 0e0 end as diff from j)
select glacier_id, ref_hgt as uncorrected_ref_hgt, ref_hgt + diff as ref_hgt, diff + 0e0 as ref_hgt_diff from s""")
def _(v):
    return rounded(mb.climate_qc(v.mon, v.par, v.bins, 4))


_NORM = f"""with {_ela_sql('', _MS + ' where yr between 1996 and 2000', 5)},
mm as (select glacier_id, bin_id, height, width, mo, any_value(mu) as mu, any_value(bias) as bias, avg(snow) as snow, avg(melt) as melt from pt where yr between 1996 and 2000 group by 1, 2, 3, 4, 5),
m as (select glacier_id, bin_id, height, width, sum(snow) - any_value(mu) * sum(melt) - any_value(bias) as mb from mm group by 1, 2, 3, 4),
h as (select m.glacier_id, sum(case when mb >= 0 then width else 0 end) / sum(width) as aar, regr_slope(mb, height) filter (where mb < 0) as mb_grad,
  sum(width * height) / sum(width) as mean_elev, max(height) as max_elev, min(height) as min_elev, any_value(case when bad = 0 then ela end) as ela
  from m left join ela on m.glacier_id = ela.glacier_id group by 1),
s as (select glacier_id, 'ela' as spot, ela as z from h where ela is not null union all select glacier_id, 'mean_elev', mean_elev from h
  union all select glacier_id, 'max_elev', max_elev from h union all select glacier_id, 'min_elev', min_elev from h),
c as (select s.glacier_id, spot, avg(temp - 0.0065e0 * (z - ref_hgt)) as temp, sum(greatest(temp - 0.0065e0 * (z - ref_hgt) + 1, 0)) / 5e0 as melt,
  sum(p * least(greatest(1 - (temp - 0.0065e0 * (z - ref_hgt)) / 2e0, 0), 1)) / 5e0 as snow from s join ms on s.glacier_id = ms.glacier_id group by 1, 2)
"""


@query("A45_climate_normals", _NORM + f"select h.glacier_id, {R('aar')} as aar, {R('mb_grad')} as mb_grad, {R('mean_elev', 4)} as mean_elev, max_elev, min_elev, {R('ela', 4)} as ela, "
       + ", ".join(f"{R(f'''max(case when spot = '{s}' then {c} end)''', 4)} as {s}_{c}" for s in ("ela", "mean_elev", "max_elev", "min_elev") for c in ("temp", "melt", "snow"))
       + " from h left join c on h.glacier_id = c.glacier_id group by h.glacier_id, aar, mb_grad, mean_elev, max_elev, min_elev, ela")
def _(v):
    out = mb.climate_normals(v.mon, v.par, v.bins, 1998, 2)
    six = [F.round(F.col(c) + 1.3e-8, 6).alias(c) for c in ("aar", "mb_grad")]
    rest = [c for c in out.columns if c not in ("glacier_id", "aar", "mb_grad")]
    four = rounded(out.select("glacier_id", *rest), 4)
    return out.select("glacier_id", *six).join(four, "glacier_id")


@query("A53_mass_balance_table", f"with {_SMB} select yr, " + ", ".join(
    f'{R(f"max(case when glacier_id = {g} then mb end)", 4)} as "{g}"' for g in range(25)) + " from smb group by 1")
def _(v):
    table = reshape.long_to_wide(mb.specific_mb(v.mon, v.par, v.bins), "yr", "glacier_id", "mb", list(range(25)))
    return rounded(reshape.drop_empty_rows(table, "yr"), 4)


@query("A53b_ela_table", f"with {_ela_sql(', yr', _MS, 1)}, e as (select * from ela where bad = 0) select yr, " + ", ".join(
    f'{R(f"max(case when glacier_id = {g} then ela end)", 4)} as "{g}"' for g in range(25)) + " from e group by 1")
def _(v):
    table = reshape.long_to_wide(mb.equilibrium_line(v.mon, v.par), "yr", "glacier_id", "ela", list(range(25)))
    return rounded(reshape.drop_empty_rows(table, "yr"), 4)


@query("A54_reference_mb_window", f"select glacier_id, yr, {R('mb')} as mb from obs_mb where yr between 1996 and 1999 and mb is not null")
def _(v):
    return rounded(mb.reference_mb_window(v.obs_mb, 1996, 1999))


_PROF = """prof as (select c_nationkey as glacier_id, cast(year(o_orderdate) as int) as yr, cast(2000 + 100 * (o_custkey % 40) as int) as band, avg(o_totalprice) as mb
  from orders join customer on o_custkey = c_custkey group by 1, 2, 3)"""


@query("A54b_mb_profile", f"""with {_PROF}, r as (select * from prof where yr between 1996 and 1999),
y as (select glacier_id, count(distinct yr) as y from r group by 1), b as (select glacier_id, band, count(distinct yr) as k from r group by 1, 2)
select r.glacier_id, r.yr, r.band, {R('r.mb', 4)} as mb from r join y on r.glacier_id = y.glacier_id
join b on b.glacier_id = r.glacier_id and b.band = r.band where k / cast(y as double) >= 0.75e0""")
def _(v):
    orders = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    prof = orders.groupBy(
        F.col("c_nationkey").alias("glacier_id"), F.year("o_orderdate").alias("yr"),
        (2000 + 100 * (F.col("o_custkey") % 40)).cast("int").alias("band"),
    ).agg(F.avg("o_totalprice").alias("mb"))
    return rounded(mb.mb_profile(prof, 1996, 1999, 0.75), 4)


_CAND = f"""{_GC}, cand as (select glacier_id, yr, case when count(*) over w = 3 and avg(temp) over w > 1e-3 then avg(prcp) over w / avg(temp) over w end as mu
  from gc window w as (partition by glacier_id order by yr rows between 1 preceding and 1 following))"""


@query("W17_mu_candidates", f"with {_CAND} select glacier_id, yr, {R('mu')} as mu from cand")
def _(v):
    return rounded(se.mu_candidates(mb.glacier_climate(v.mon, v.par, v.bins), half=1).select("glacier_id", "yr", "mu"))


@query("W18_best_reference_year", f"""with {_CAND}, ref as (select gc.glacier_id, avg(prcp) as p, avg(temp) as t, avg(mb) as mb from gc join obs_mb o
  on gc.glacier_id = o.glacier_id and gc.yr = o.yr group by 1),
d as (select c.glacier_id, c.yr, c.mu, ref.p - c.mu * ref.t - ref.mb as bias from cand c join ref on c.glacier_id = ref.glacier_id where c.mu is not null),
k as (select *, row_number() over (partition by glacier_id order by abs(bias), yr) as rn from d)
select glacier_id, yr as t_star, {R('mu')} as mu, {R('bias', 4)} as bias from k where rn = 1""")
def _(v):
    clim = mb.glacier_climate(v.mon, v.par, v.bins)
    best = se.best_reference_year(se.mu_candidates(clim, half=1), clim, v.obs_mb)
    return rounded(best.withColumn("bias", F.round(F.col("bias") + 1.3e-6, 4)))


@query("W22_snow_bucket", f"""with recursive s as (select glacier_id, row_number() over (partition by glacier_id order by yr, mo) as i,
  prcp * 0.1e0 as snow, greatest(temp + 8, 0) as melt, yr, mo from mon),
b as (select glacier_id, i, greatest(snow - melt, 0) as bucket from s where i = 1
  union all select s.glacier_id, s.i, greatest(b.bucket + s.snow - s.melt, 0) from b join s on s.glacier_id = b.glacier_id and s.i = b.i + 1)
select s.glacier_id, s.yr, s.mo, {R('b.bucket')} as bucket,
  {R('least(s.melt, coalesce(p.bucket, 0) + s.snow)')} as melt_limited
from s join b on s.glacier_id = b.glacier_id and s.i = b.i left join b p on p.glacier_id = s.glacier_id and p.i = s.i - 1""")
def _(v):
    m = v.mon.select("glacier_id", "yr", "mo", (F.col("prcp") * 0.1).alias("snow"), F.greatest(F.col("temp") + 8, F.lit(0.0)).alias("melt"))
    out = se.snow_bucket(m, ["glacier_id"], ["yr", "mo"], "snow", "melt")
    return rounded(out.select("glacier_id", "yr", "mo", "bucket", "melt_limited"))


_OFF = "greatest(width * 10e0 - width * (bin_id % 4) * 4e0, 0)"
_ON = "width * (bin_id % 4) * 4e0"


@query("W23_runoff_components", f"""with a as (select *, {_ON} as on_a, {_OFF} as off_a,
  case when bias = 0 then greatest(snow - (snow - mu * melt - bias / 12e0), 0) else snow - (snow - mu * melt - bias / 12e0) end as m from pt),
c as (select *, sum(snow * off_a - m * off_a) over w as c from a window w as (partition by glacier_id, bin_id order by yr, mo)),
k as (select *, c - least(0, min(c) over (partition by glacier_id, bin_id order by yr, mo)) as bucket from c),
l as (select *, least(m * off_a, coalesce(lag(bucket) over (partition by glacier_id, bin_id order by yr, mo), 0) + snow * off_a) as mo_off from k)
select glacier_id, yr, mo, {R('sum(mo_off)', 3)} as melt_off, {R('sum(m * on_a)', 3)} as melt_on, {R('sum(bias / 12e0 * off_a)', 3)} as residual_off,
  {R('sum(bias / 12e0 * on_a)', 3)} as residual_on, {R('sum((prcp - snow) * off_a)', 3)} as rain_off, {R('sum((prcp - snow) * on_a)', 3)} as rain_on,
  {R('sum(snow * off_a)', 3)} as snow_off, {R('sum(snow * on_a)', 3)} as snow_on, {R('sum(bucket)', 3)} as snow_bucket from l group by 1, 2, 3""")
def _(v):
    areas = v.bins.select(
        "glacier_id", "bin_id", (F.col("width") * (F.col("bin_id") % 4) * 4.0).alias("bin_area"), (F.col("width") * 10.0).alias("ref_area")
    )
    return rounded(mb.runoff_components(_points(v), areas), 3)
