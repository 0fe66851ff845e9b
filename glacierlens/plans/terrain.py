"""Queries on pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.operators import terrain as te
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R

# pixel rows in blocks of 100 lines are the rasters of the glaciers
_PX = "z as (select cast(floor(r / 100e0) as int) as glacier_id, r, c, 3000e0 + value * 400e0 + c * 3e0 as value, mask from px)"
DX = 50.0


def _z(v):
    return v.px.select(
        F.floor(F.col("r") / 100.0).cast("int").alias("glacier_id"), "r", "c",
        (3000.0 + F.col("value") * 400.0 + F.col("c") * 3.0).alias("value"), "mask",
    )


_GRAD = f"""{_PX}, g as (select *, coalesce((lead(value) over wr - lag(value) over wr) / 100e0, (lead(value) over wr - value) / 50e0, (value - lag(value) over wr) / 50e0) as sy,
  coalesce((lead(value) over wc - lag(value) over wc) / 100e0, (lead(value) over wc - value) / 50e0, (value - lag(value) over wc) / 50e0) as sx
  from z window wr as (partition by glacier_id, c order by r), wc as (partition by glacier_id, r order by c)),
s as (select *, atan(sqrt(sx * sx + sy * sy)) as slope, atan2(-sx, sy) as asp from g)"""


@query("A41_slope_aspect", f"with {_GRAD} select glacier_id, r, c, {R('slope')} as slope, {R('case when asp < 0 then asp + 2 * pi() else asp end')} as aspect from s")
def _(v):
    return rounded(te.slope_aspect(_z(v), DX).select("glacier_id", "r", "c", "slope", "aspect"))


@query("A39_hypsometry", f"""with {_PX}, n as (select glacier_id, cast(floor(value / 50e0) as bigint) as b, count(*) as n from z group by 1, 2),
h as (select *, n * 1000e0 / sum(n) over (partition by glacier_id) as h from n),
k as (select *, floor(h) as f, 1000 - sum(floor(h)) over (partition by glacier_id) as rest, row_number() over (partition by glacier_id order by h - floor(h) desc, b) as rn from h),
e as (select glacier_id, unnest(generate_series(min(b), max(b))) as b from n group by 1)
select e.glacier_id, (e.b + 0.5e0) * 50e0 as bin_center, cast(coalesce(f + case when rn <= rest and h > f then 1 else 0 end, 0) as int) as permille
from e left join k on e.glacier_id = k.glacier_id and e.b = k.b""")
def _(v):
    return te.hypsometry(_z(v), 50.0)


@query("A39b_hypsometry_summary", f"""with {_GRAD} select glacier_id, {R('min(value)')} as z_min, {R('max(value)')} as z_max, {R('median(value)')} as z_med,
  {R('degrees(avg(slope))')} as slope_deg, {R('case when atan2(avg(-sx), avg(sy)) < 0 then degrees(atan2(avg(-sx), avg(sy))) + 360 else degrees(atan2(avg(-sx), avg(sy))) end', 4)} as aspect_deg from s group by 1""")
def _(v):
    out = te.hypsometry_summary(_z(v), DX)
    return rounded(out.withColumn("aspect_deg", F.round(F.col("aspect_deg") + 1.3e-6, 4)))


_BINS = f"""{_GRAD}, t as (select *, least(greatest(slope, radians(0.4e0)), radians(60e0)) as sl from s),
en as (select glacier_id, case when floor(max(value) / 30e0) > floor(min(value) / 30e0) then 30e0 when floor(max(value) / 10e0) > floor(min(value) / 10e0) then 10e0 end as step from t group by 1),
b as (select t.*, step, cast(floor(value / step) as bigint) as b from t join en on t.glacier_id = en.glacier_id where step is not null),
q as (select glacier_id, b, quantile_cont(sl, 0.05) as q05, least(greatest(2 * quantile_cont(sl, 0.2) / quantile_cont(sl, 0.8), 0.55e0), 0.95e0) as x, list_sort(list(sl)) as l from b group by 1, 2),
p as (select *, (len(l) - 1) * x as pos from q),
w as (select *, l[cast(floor(pos) as bigint) + 1] + (l[cast(ceil(pos) as bigint) + 1] - l[cast(floor(pos) as bigint) + 1]) * (pos - floor(pos)) as qx from p),
a as (select b.glacier_id, b.b, any_value(step) as step, count(*) * 2500e0 as area, avg(value) as mean_elevation, avg(c * 1e0) as cc,
  least(greatest(coalesce(avg(sl) filter (where sl between q05 and qx), avg(sl)), radians(0.4e0)), radians(60e0)) as slope
  from b join w on b.glacier_id = w.glacier_id and b.b = w.b group by 1, 2),
o as (select *, step / tan(slope) as dx, (b + 0.5e0) * step as bin_elevation from a),
tot as (select glacier_id, sum(c * 1e0) * 2500e0 as tin from z group by 1),
d as (select o.*, lag(dx) over (partition by o.glacier_id order by b desc) as pdx, tin, sum(cc * area) over (partition by o.glacier_id) as tout from o join tot on o.glacier_id = tot.glacier_id)
select glacier_id, area, {R('mean_elevation')} as mean_elevation, {R('slope')} as slope, {R('bin_elevation')} as bin_elevation, {R('dx')} as dx,
  {R('area / dx')} as width, {R('cc * tin / tout')} as cc, {R('sum(case when pdx is null then dx / 2 else (dx + pdx) / 2 end) over (partition by glacier_id order by b desc)', 4)} as distance from d"""


@query("A40_elevation_bins", f"with {_BINS}")
def _(v):
    px = te.slope_aspect(_z(v), DX).withColumn("cc", F.col("c").cast("double"))
    out = te.elevation_bins(px, DX, 30.0, ["cc"], ["cc"])
    return rounded(out.withColumn("distance", F.round(F.col("distance") + 1.3e-6, 4)))


@query("A42_dem_coverage", f"""with {_PX}, s as (select cast(c % 4 as int) as source, glacier_id, mask, case when c % 4 = 3 then 5e0 when value < 2950 then -9999e0 else value end as value from z)
select source, glacier_id, {R('count(*) filter (where value > -999) / cast(count(*) as double)')} as coverage from s where mask group by 1, 2
having count(*) filter (where value > -999) > 0 and min(case when value > -999 then value end) <> max(case when value > -999 then value end)""")
def _(v):
    s = _z(v).withColumn("source", (F.col("c") % 4).cast("int"))
    # source 3 is flat everywhere
    val = F.when(F.col("source") == 3, 5.0).when(F.col("value") < 2950, -9999.0).otherwise(F.col("value"))
    return rounded(te.dem_coverage(s.withColumn("value", val)))


_TH = f"""{_PX}, t as (select glacier_id, mask, case when value < 3000 then null else (value - 2950) / 10e0 end as thick, abs(value - 3100) / 50e0 as e, value / 100e0 as vx, c * 1e0 as vy from z),
ar as (select n_nationkey as glacier_id, 2e0 + n_nationkey as area_km2 from nation)"""


@query("A43_thickness_stats", f"""with {_TH}, o as (select glacier_id, coalesce(sum(thick), 0) * 2500e0 * 1e-9 as v, count(thick) * 2500e0 * 1e-6 as a, sum(e) * 2500e0 * 1e-9 as ve,
  avg(sqrt(vx * vx + vy * vy)) as av, max(sqrt(vx * vx + vy * vy)) as mv, avg(sqrt(e * e + 0.25e0)) as ev from t where mask group by 1)
select ar.glacier_id, area_km2, {R('coalesce(v, 0)', 9)} as vol_km3, {R('coalesce(a, 0)', 9)} as cov_area_km2, {R('coalesce(a / area_km2, 0)', 9)} as coverage,
  {R('ve', 9)} as vol_err_km3, {R('av', 9)} as avg_vel, {R('mv', 9)} as max_vel, {R('ev', 9)} as avg_err_vel from ar left join o on ar.glacier_id = o.glacier_id""")
def _(v):
    val = F.col("value")
    px = _z(v).select(
        "glacier_id", "mask", F.when(val >= 3000, (val - 2950) / 10.0).alias("thick"), (F.abs(val - 3100) / 50.0).alias("thick_err"),
        (val / 100.0).alias("vx"), F.col("c").cast("double").alias("vy"), (F.abs(val - 3100) / 50.0).alias("err_vx"), F.lit(0.5).alias("err_vy"),
    )
    areas = v.table("nation").select(F.col("n_nationkey").alias("glacier_id"), (2.0 + F.col("n_nationkey")).alias("area_km2"))
    return rounded(te.thickness_stats(px, areas, DX), 9)


@query("A44_glacier_statistics", f"""with {_PX}, tp as (select glacier_id, max(value) as top from z where c in (0, 63) group by 1),
d as (select z.glacier_id, avg(value) as me, min(value) as mi, max(value) as ma, median(value) as md, max(top) as top, avg(case when value > top then 1e0 else 0e0 end) as sh, count(*) as px
  from z left join tp on z.glacier_id = tp.glacier_id where mask group by 1),
l as (select glacier_id, sum(width * height) / sum(width) as fm, min(height) as fi, max(height) as fa, avg(width) as fw, avg(0.1e0 + width / 1000e0) as fs from bins group by 1)
select gl.glacier_id, name, {R('area_km2')} as area_km2, {R('0.034e0 * pow(area_km2, 1.375e0)')} as vas_volume_km3, {R('me')} as dem_mean_elev, {R('mi')} as dem_min_elev, {R('ma')} as dem_max_elev,
  {R('md')} as dem_med_elev, {R('top')} as dem_max_elev_on_ext, {R('sh')} as dem_share_above_ext, px as n_pixels, {R('fm')} as flowline_mean_elev, fi as flowline_min_elev, fa as flowline_max_elev,
  {R('fw')} as flowline_avg_width, {R('fs')} as flowline_avg_slope from gl left join d on gl.glacier_id = d.glacier_id left join l on gl.glacier_id = l.glacier_id""")
def _(v):
    px = _z(v).withColumn("ext", F.col("c").isin(0, 63))
    bins = v.bins.withColumn("slope", 0.1 + F.col("width") / 1000.0)
    gl = v.gl.select("glacier_id", "name", "area_km2")
    # the caller's own aggregate rides along
    return rounded(te.glacier_statistics(gl, px, bins, extra=[F.count("*").alias("n_pixels")]))


@query("X02_statistics_hook", f"""with {_PX} select gl.glacier_id, {R('avg(value * value)', 3)} as mean_square, count(r) as n_pixels
from gl left join z on gl.glacier_id = z.glacier_id and mask group by 1""")
def _(v):
    extra = [F.avg(F.col("value") * F.col("value")).alias("mean_square"), F.count("*").alias("n_pixels")]
    out = te.glacier_statistics(v.gl.select("glacier_id", "area_km2"), _z(v).withColumn("ext", F.lit(True)), extra=extra)
    return rounded(out.select("glacier_id", "mean_square", F.coalesce("n_pixels", F.lit(0)).cast("long").alias("n_pixels")), 3)


# the total is added up in three limbs, each without rounding, so that no order of the rows shows in the last digit
@query("A48_conserve_total", f"""with {_PX}, p as (select glacier_id, r, c, greatest(value - 2950, 0e0) as x from z),
q as (select *, x % 1e0 * 2097152e0 as f from p),
s as (select glacier_id, sum(x - x % 1e0) + (sum(f - f % 1e0) + sum(f % 1e0)) / 2097152e0 as s from q group by 1)
select p.glacier_id, r, c, {R('nullif(x * ((1e6 + p.glacier_id * 1e5) / s.s), 0)')} as thick from p join s on p.glacier_id = s.glacier_id""")
def _(v):
    field = _z(v).select("glacier_id", "r", "c", (F.col("value") - 2950).alias("thick"))
    # every glacier of the pixels has a target
    targets = field.select("glacier_id").distinct().withColumn("target", 1e6 + F.col("glacier_id") * 1e5)
    return rounded(te.conserve_total(field, ["glacier_id"], "thick", targets))


@query("A49_local_lapse_rate", f"""with s as (select region15, cast(month(obs_date) as int) as mo, elev_ref as x, dh / 10e0 - elev_ref * 0.0001e0 * (month(obs_date) % 5) as y from fp),
m as (select region15, mo, count(*) as n, regr_slope(y, x) as k, corr(y, x) as r from s group by 1, 2)
select region15, mo, n, {R("case when n >= 5 and abs(r) * sqrt((n - 2) / (1 - r * r)) > 2.5758293e0 + 4.9167e0 / (n - 2) then k end", 9)} as gradient from m""")
def _(v):
    mo = F.month("obs_date")
    pts = v.fp.select("region15", mo.alias("mo"), "elev_ref", (F.col("dh") / 10.0 - F.col("elev_ref") * 0.0001 * (mo % 5)).alias("t"))
    return rounded(te.local_lapse_rate(pts, ["region15", "mo"], "elev_ref", "t"), 9)


@query("W24_rank_in_band", f"""with {_PX}, n as (select glacier_id, count(*) as n from z group by 1),
k as (select z.*, n, rank() over (partition by z.glacier_id order by value) + (count(*) over (partition by z.glacier_id, value) - 1) / 2e0 as rk, min(value) over (partition by z.glacier_id) as zm
  from z join n on z.glacier_id = n.glacier_id),
b as (select *, case when rk < round(floor(n / 4e0)) then 2 when rk < round(floor(n / 4e0) + floor(n / 3e0)) then 1 else 0 end as band, (value - zm + 1) * 1.003e0 * (10e0 + c) as w from k)
select glacier_id, r, c, rk as rank, cast(band as int) as band, rank() over (partition by glacier_id, band order by w) + (count(*) over (partition by glacier_id, band, w) - 1) / 2e0 as rank_in_band from b""")
def _(v):
    px = _z(v).withColumn("thick", 10.0 + F.col("c"))
    n = px.groupBy("glacier_id").agg(F.count("*").alias("n"))
    low, mid = F.floor(F.col("n") / 4.0), F.floor(F.col("n") / 3.0)
    bands = n.withColumn("band", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "glacier_id", "band", F.when(F.col("band") == 2, low).when(F.col("band") == 1, mid).otherwise(F.col("n") - low - mid).cast("double").alias("n_pixels")
    )
    return te.rank_in_band(px, bands).select("glacier_id", "r", "c", "rank", "band", "rank_in_band")
