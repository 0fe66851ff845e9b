"""Queries on points, polygons and rasters, and plain projections (P, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.functions import scalars as sc
from glacierlens.operators import altimetry as alt
from glacierlens.operators import climate as cl
from glacierlens.operators import filters as fl
from glacierlens.operators import spatial as sp
from glacierlens.operators import timewindows as tw
from glacierlens.plans.fixtures import END, REF_DATE, START
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R, inside
from glacierlens.sources import scans

GRID = sp.Affine(66.0, 47.0, 0.625, 0.044)
_RC = "cast(ceil((47e0 - {0}lat) / 0.044e0) - 1 as bigint)", "cast(ceil(({0}lon - 66e0) / 0.625e0) - 1 as int)"


def _rc(prefix=""):
    return tuple(t.format(prefix) for t in _RC)


# ---- P: projections and filters

@query("P01_bbox_filter", f"""select track, {R('lon')} as lon, {R('lat')} as lat, obs_day from fp
where lon between 69.9e0 and 80.1e0 and lat between 29.9e0 and 35.1e0""")
def _(v):
    return rounded(fl.bbox_filter(v.fp, (70.0, 30.0, 80.0, 35.0)).select("track", "lon", "lat", "obs_day"))


@query("P02_max_elev_filter", f"select track, obs_day, {R('h_obs')} as h_obs from fpx where h_obs <= 8700")
def _(v):
    return rounded(fl.max_elev_filter(v.fpx, 8700.0).select("track", "obs_day", "h_obs"))


@query("P03_qc_height_change", """select count(*) as n_before, count(*) filter (where abs(dh) <= 200) as n_after,
  count(*) filter (where abs(dh) > 200) as n_removed from fp""")
def _(v):
    return alt.qc_counts(v.fp, 200.0)


@query("P04_dh_photon", f"""select track, obs_day, {R('h_obs - geoid - elev_ref')} as dh_raw,
  {R('h_obs - geoid - (elev_ref + pdd + vshift)')} as dh from fpc
where abs(h_obs - geoid - (elev_ref + pdd + vshift)) <= 200""")
def _(v):
    pts = fl.cell_lookup(v.fpx, v.cells, ["pdd", "vshift"])
    return rounded(fl.dh_photon(pts).select("track", "obs_day", "dh_raw", "dh"))


_LASER = """h_obs + case when sat_flag = 2 then sat_corr else 0e0 end
  - (0.8337e0 - 0.3848e0 * sin(radians(lat)) * sin(radians(lat))) - geoid - elev_ref"""


@query("P05_dh_laser", f"select track, obs_day, {R(_LASER)} as dh, {R(_LASER + ' - pdd')} as dh_pdd from fpc")
def _(v):
    pts = fl.cell_lookup(v.fpx, v.cells, ["pdd", "vshift"])
    return rounded(fl.dh_laser(pts).select("track", "obs_day", "dh", "dh_pdd"))


@query("P06_dh_radar", f"select track, obs_day, {R('h_obs - geoid - (elev_ref + pdd)')} as dh from fpc")
def _(v):
    pts = fl.cell_lookup(v.fpx, v.cells, ["pdd", "vshift"])
    return rounded(fl.dh_radar(pts).select("track", "obs_day", "dh"))


@query("P07_cell_id", """select floor(lon / 0.5e0) * 0.5e0 as cell_lon, floor(lat / 0.5e0) * 0.5e0 as cell_lat,
  floor(lon / 0.5e0) * 0.5e0 + 0.25e0 as center_lon, floor(lat / 0.5e0) * 0.5e0 + 0.25e0 as center_lat,
  count(*) as n from fp group by 1, 2, 3, 4""")
def _(v):
    c = fl.with_cell(v.fp, 0.5)
    return c.groupBy("cell_lon", "cell_lat", "center_lon", "center_lat").agg(F.count("*").alias("n"))


@query("P08_days_since", """select o_orderkey, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day,
  cast(o_orderdate as date) as back,
  cast(trunc((date_diff('day', date '1970-01-01', cast(o_orderdate as date)) + 11000) / 2) as int) as mid from orders""")
def _(v):
    o = v.table("orders").select("o_orderkey", sc.days_since("o_orderdate", "1970-01-01").alias("day"))
    return o.withColumn("back", sc.date_of("day", "1970-01-01")).withColumn("mid", sc.mid_day("day", F.lit(11000)))


@query("P09_period_filter", f"""select glacier_id, variable, obs_date, {R('value')} as value from dly
where obs_date >= date '1996-05-01' and obs_date < date '1998-02-01'""")
def _(v):
    return rounded(cl.period_filter(v.dly, "obs_date", "1996-05-01", "1998-02-01"))


@query("P10_area_class", """select s.* from scores s
where glacier_id in (select glacier_id from gl where area_km2 >= 5 and area_km2 < 15)""")
def _(v):
    return fl.area_class(v.gl, v.scores, 5.0, 15.0)


@query("P11_to_monthly_units", f"""select glacier_id, yr, mo, {R('(temp + 273.15e0) - 273.15e0')} as temp_c,
  {R("(prcp / 30000e0) * 1000e0 * day(last_day(make_date(yr, mo, 1)))")} as prcp_mm,
  {R("(prcp / 2592000e0) * list_extract([31,28,31,30,31,30,31,31,30,31,30,31], mo) * 86400e0")} as prcp_flux_mm,
  {R('(prcp * 10e0) / 9.80665e0')} as height_m from mon""")
def _(v):
    raw = v.mon.select(
        "glacier_id", "yr", "mo", (F.col("temp") + 273.15).alias("temp_k"), (F.col("prcp") / 30000.0).alias("tp_m_day"),
        (F.col("prcp") / 2592000.0).alias("pr_flux"), (F.col("prcp") * 10.0).alias("geopotential"),
    )
    return rounded(
        fl.monthly_units(raw).select("glacier_id", "yr", "mo", "temp_c", "prcp_mm", "prcp_flux_mm", "height_m")
    )


@query("P12_wrap_lon", f"""select glacier_id, {R('case when cen_lon * 2 > 180 then cen_lon * 2 - 360 else cen_lon * 2 end')} as lon180,
  {R('case when cen_lon - 90 < 0 then cen_lon - 90 + 360 else cen_lon - 90 end')} as lon360 from gl""")
def _(v):
    return rounded(v.gl.select(
        "glacier_id", sc.wrap_lon_180(F.col("cen_lon") * 2).alias("lon180"),
        sc.wrap_lon_360(F.col("cen_lon") - 90).alias("lon360"),
    ))


@query("P13_year_fraction", f"""select o_orderkey, {R("year(d) + (dayofyear(d) - 1) / cast(date_diff('day', make_date(year(d), 1, 1), make_date(year(d) + 1, 1, 1)) as double)")} as yf
from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def _(v):
    o = v.table("orders")
    return rounded(o.select("o_orderkey", sc.year_fraction(F.col("o_orderdate").cast("date")).alias("yf")))


@query("P14_floatyear", f"""select glacier_id, yr, mo, {R('yr + (mo - 1) / 12e0', 9)} as floatyear, yr as back_year, mo as back_month from mon""")
def _(v):
    m = v.mon.select("glacier_id", "yr", "mo", sc.date_to_floatyear("yr", "mo").alias("floatyear"))
    y, mo = sc.floatyear_to_date("floatyear")
    return rounded(m.withColumn("back_year", y).withColumn("back_month", mo), 9)


@query("P15_hydro_calendar", """select glacier_id, yr, mo,
  cast(case when mo >= 10 then yr + 1 else yr end as int) as hydro_year,
  cast(case when mo >= 10 then mo - 9 else mo + 3 end as int) as hydro_month,
  yr as cal_year, mo as cal_month from mon""")
def _(v):
    hy, hm = sc.calendar_to_hydro("yr", "mo", 10)
    m = v.mon.select("glacier_id", "yr", "mo", hy.alias("hydro_year"), hm.alias("hydro_month"))
    cy, cm = sc.hydro_to_calendar("hydro_year", "hydro_month", 10)
    return m.withColumn("cal_year", cy).withColumn("cal_month", cm)


@query("P16_monthly_axis", f"""with ax as (select cast(y as int) as yr, cast(m as int) as mo
  from (select unnest(generate_series(1995, 2001)) as y) a, (select unnest(generate_series(1, 12)) as m) b where y < 2001 or m = 1)
select ax.yr, ax.mo, {R('ax.yr + (ax.mo - 1) / 12e0', 9)} as floatyear, count(glacier_id) as n
from ax left join mon on ax.yr = mon.yr and ax.mo = mon.mo group by 1, 2, 3""")
def _(v):
    axis = fl.monthly_axis(v.spark, 1995, 2001)
    out = axis.join(v.mon, ["yr", "mo"], "left").groupBy("yr", "mo", "floatyear").agg(F.count("glacier_id").alias("n"))
    return rounded(out, 9)


@query("P17_haversine", f"""select glacier_id, {R('''2 * 6371000e0 * asin(sqrt(pow(sin((radians(36e0) - radians(cen_lat)) / 2), 2)
  + cos(radians(cen_lat)) * cos(radians(36e0)) * pow(sin((radians(85e0) - radians(cen_lon)) / 2), 2)))''', 3)} as dist from gl""")
def _(v):
    return rounded(v.gl.select("glacier_id", sc.haversine("cen_lon", "cen_lat", F.lit(85.0), F.lit(36.0)).alias("dist")), 3)


@query("P18_clip_nice_number", f"""select bin_id, {R('case when width < 95 then 95 when width > 130 then 130 else width end')} as clipped,
  (floor(height / 50e0) + 1) * 50e0 as above, floor(height / 50e0) * 50e0 as below from bins""")
def _(v):
    return rounded(v.bins.select(
        "bin_id", sc.clip("width", 95.0, 130.0).alias("clipped"), sc.nice_number("height", 50.0).alias("above"),
        sc.nice_number("height", 50.0, lower=True).alias("below"),
    ))


_TITLE = """array_to_string(list_transform(range(1, length(s) + 1), lambda i: case when i > 1 and
  regexp_matches(s[i - 1], '[A-Za-z]') then lower(s[i]) else upper(s[i]) end), '')"""


@query("P19_clean_name", f"""select glacier_id, {_TITLE} as name from
  (select glacier_id, trim(regexp_replace(name, '[ÀÈèÐ°¾¤30`/C@Å^å;]+$', '')) as s from gl)""")
def _(v):
    return v.gl.select("glacier_id", sc.clean_name("name").alias("name"))


@query("P20_offset_correct", f"""select region22, {R('avg(dh + coalesce(case when n_nationkey < 20 then n_regionkey * 0.1e0 end, 0))')} as dh, count(*) as n
from fp join nation on region22 = n_nationkey group by 1""")
def _(v):
    # some regions have no offset, to show that their rows stay as they are
    corr = v.table("nation").where(F.col("n_nationkey") < 20).select(
        F.col("n_nationkey").alias("region22"), (F.col("n_regionkey") * 0.1).alias("offset")
    )
    out = fl.offset_correct(v.fp, corr, ["region22"])
    return rounded(out.groupBy("region22").agg(F.avg("dh").alias("dh"), F.count("*").alias("n")))


_PERIODS = "case when rgi_id % 2 = 0 then '2000-01-01_2010-01-01' else '2000-01-01_2020-01-01' end"


@query("P21_rgi_region_filter", f"""select rgi_id, region, {R('dmdtda')} as dmdtda, area, is_cor, {_PERIODS} as period from geodetic
where region in (13, 14, 15) and {_PERIODS} = '2000-01-01_2020-01-01'""")
def _(v):
    g = v.geodetic.withColumn("period", F.expr(_PERIODS))
    return rounded(fl.period_pick(fl.region_filter(g, [13, 14, 15]), "2000-01-01_2020-01-01"))


@query("P22_speed_rescale", f"""with c as (select c_custkey as id, c_acctbal / 1000e0 as vx, (c_custkey % 7 - 3) / 2e0 as vy,
  c_acctbal / 700e0 as vx0, (c_custkey % 5 - 2) / 2e0 as vy0 from customer),
f as (select *, sqrt(vx * vx + vy * vy) as v, case when sqrt(vx * vx + vy * vy) > 1 then sqrt(vx0 * vx0 + vy0 * vy0) / sqrt(vx * vx + vy * vy) else 1e0 end as k from c)
select id, {R('v')} as speed, {R('vx * k')} as vx, {R('vy * k')} as vy from f""")
def _(v):
    k = F.col("c_custkey")
    c = v.table("customer").select(
        k.alias("id"), (F.col("c_acctbal") / 1000.0).alias("vx"), ((k % 7 - 3) / 2.0).alias("vy"),
        (F.col("c_acctbal") / 700.0).alias("vx0"), ((k % 5 - 2) / 2.0).alias("vy0"),
    ).withColumn("speed", sc.speed("vx", "vy"))
    return rounded(fl.rescale_velocity(c).select("id", "speed", "vx", "vy"))


@query("P23_valid_glaciers", """select glacier_id, name from gl
where glacier_id in (select glacier_id from scores) and glacier_id in (select glacier_id from bins)""")
def _(v):
    return fl.valid_glaciers(v.gl, [v.scores, v.bins]).select("glacier_id", "name")


# ---- J: joins

_TAGS = f"""with p as (select distinct lon, lat from fp),
t as (select lon, lat, max(id) as id from {inside('p.lon', 'p.lat', 'p', 'p.lon, p.lat')} group by 1, 2)
"""


@query("J01_tag_regions", _TAGS + f"""select fp.track, fp.obs_day, {R('fp.lon')} as lon, {R('fp.lat')} as lat, cast(coalesce(t.id, 0) as int) as r22
from fp left join t on fp.lon = t.lon and fp.lat = t.lat""")
def _(v):
    pts = v.fp.select("track", "obs_day", "lon", "lat")
    return rounded(sp.tag_regions(pts, v.hpoly, ["r22"]))


_HOLES = f"""with p as (select distinct lon, lat from fp), t as (select distinct lon, lat from {inside('p.lon', 'p.lat', 'p', 'p.lon, p.lat').replace('join edge e on true', "join (select * from edge where id % 2 = 1) e on true")})
"""


@query("J02_outside_all", _HOLES + f"""select fp.track, fp.obs_day, {R('fp.lon')} as lon, {R('fp.lat')} as lat
from fp left join t on fp.lon = t.lon and fp.lat = t.lat where t.lon is null""")
def _(v):
    # every second rectangle, so that some points lie outside
    pts = v.fp.select("track", "obs_day", "lon", "lat")
    return rounded(sp.outside_all(pts, v.hpoly.where(F.col("id") % 2 == 1)))


@query("J03_within_boundary", _TAGS.replace("join edge e on true", "join (select * from edge where id = 7) e on true")
       + f"""select fp.track, fp.obs_day, {R('fp.lon')} as lon, {R('fp.lat')} as lat
from fp join t on fp.lon = t.lon and fp.lat = t.lat""")
def _(v):
    pts = v.fp.select("track", "obs_day", "lon", "lat")
    return rounded(sp.within_boundary(pts, v.hpoly.where(F.col("id") == 7)))


@query("J04_select_glaciers", f"""select gl.glacier_id, gl.name, h.id as region_id from gl
join {inside('g.cen_lon', 'g.cen_lat', 'gl g', 'g.glacier_id')} h on gl.glacier_id = h.glacier_id""")
def _(v):
    pts = v.gl.select("glacier_id", "name", "cen_lon", "cen_lat")
    return sp.select_glaciers(pts, v.hpoly).select("glacier_id", "name", F.col("region_id").cast("int").alias("region_id"))


@query("J05_cell_lookup", f"""select track, obs_day, {R('lon')} as lon, {R('lat')} as lat, {R('pdd')} as pdd, {R('vshift')} as vshift from fpc""")
def _(v):
    out = fl.cell_lookup(v.fpx, v.cells, ["pdd", "vshift"])
    return rounded(out.select("track", "obs_day", "lon", "lat", "pdd", "vshift"))


@query("J06_sample_raster", f"""select f.track, f.obs_day, {R('f.lon')} as lon, {R('f.lat')} as lat, {R('px.value')} as value
from (select *, {_rc()[0]} as r, {_rc()[1]} as c from fp) f left join px on f.r = px.r and f.c = px.c""")
def _(v):
    pts = v.fp.select("track", "obs_day", "lon", "lat")
    return rounded(sp.sample_raster(pts, v.px, GRID).select("track", "obs_day", "lon", "lat", "value"))


@query("J07_focal_mean", f"""with f as (select track, obs_day, lon, lat, {_rc()[0]} as r, {_rc()[1]} as c from fp),
cell as (select distinct r, c from f), box as (select max(r) as mr, max(c) as mc from px),
m as (select cell.r, cell.c, avg(px.value) as focal from cell, box, px
  where px.r between cell.r - 1 and cell.r + 1 and px.c between cell.c - 1 and cell.c + 1
    and cell.r >= 1 and cell.c >= 1 and cell.r + 1 <= mr and cell.c + 1 <= mc group by 1, 2)
select f.track, f.obs_day, {R('f.lon')} as lon, {R('f.lat')} as lat, {R('m.focal')} as focal
from f left join m on f.r = m.r and f.c = m.c""")
def _(v):
    pts = v.fp.select("track", "obs_day", "lon", "lat")
    return rounded(sp.focal_mean(pts, v.px, GRID, 3).select("track", "obs_day", "lon", "lat", "focal"))


@query("J08_mask_split", f"""select coalesce(px.mask, false) as on_glacier, count(*) as n, {R('avg(dh)')} as dh
from (select *, {_rc()[0]} as r, {_rc()[1]} as c from fp) f left join px on f.r = px.r and f.c = px.c group by 1""")
def _(v):
    out = sp.mask_split(v.fp, v.px, GRID)
    return rounded(out.groupBy("on_glacier").agg(F.count("*").alias("n"), F.avg("dh").alias("dh")))


@query("J09_zonal_mean", f"""with box as (select id, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2 from poly group by 1),
side as (select id, r, c, value, least(x2, 66e0 + (c + 1) * 0.625e0) - greatest(x1, 66e0 + c * 0.625e0) as dx,
  least(y2, 47e0 - r * 0.044e0) - greatest(y1, 47e0 - (r + 1) * 0.044e0) as dy from box, px),
z as (select id, sum(dx * dy * value) / sum(dx * dy) as value from side where dx > 0 and dy > 0 group by 1)
select n_nationkey as id, {R('z.value')} as value from nation left join z on n_nationkey = z.id""")
def _(v):
    weights = sp.coverage_weights(v.px, v.hpoly, GRID)
    return rounded(sp.zonal_mean(v.poly, weights, v.px))


@query("J10_nearest_grid_point", f"""with d as (select glacier_id, cen_lon, cen_lat, p.idx, p.lon, p.lat,
  row_number() over (partition by glacier_id order by pow(cen_lon - p.lon, 2) + pow(cen_lat - p.lat, 2), p.idx) as rn from gl, pts p)
select glacier_id, idx, lon as grid_lon, lat as grid_lat, {R('''2 * 6371000e0 * asin(sqrt(pow(sin((radians(lat) - radians(cen_lat)) / 2), 2)
  + cos(radians(cen_lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(cen_lon)) / 2), 2)))''', 3)} as distance_m from d where rn = 1""")
def _(v):
    return rounded(sp.nearest_grid_point(v.gl, v.pts, "glacier_id"), 3)


@query("J11_window_join", """select w.win_kind, w.win_id, count(*) as n, cast(sum(obs_day) as bigint) as days from fp
join (select * from win_year union all select * from win_season) w on obs_day >= start_day and obs_day < end_day group by 1, 2""")
def _(v):
    span = (v.spark, START, END, REF_DATE)
    win = tw.annual_windows(*span).unionByName(tw.seasonal_windows(*span))
    out = tw.window_join(v.fp, win, REF_DATE)
    return out.groupBy("win_kind", "win_id").agg(F.count("*").alias("n"), F.sum("obs_day").alias("days"))


@query("J13_align_obs_sim", f"""select o.glacier_id, o.yr, {R('o.mb')} as obs, cast(s.score as double) as sim
from obs_mb o join scores s on o.glacier_id = s.glacier_id and o.yr = s.yr where o.mb is not null and s.score is not null""")
def _(v):
    obs = v.obs_mb.withColumnRenamed("mb", "obs")
    sim = v.scores.select("glacier_id", "yr", F.col("score").cast("double").alias("sim"))
    return rounded(sp.align_obs_sim(obs, sim, ["glacier_id", "yr"]))


@query("J14_share_edge", """with t as (select n_nationkey as id, 66e0 + 8e0 * (n_nationkey % 5) as x0, 25e0 + 4.5e0 * floor(n_nationkey / 5e0) as y0 from nation)
select a.id as id_1, b.id as id_2, round(case when a.x0 = b.x0 then 8e0 else 4.5e0 end, 6) as shared_length from t a, t b
where a.id < b.id and ((a.x0 = b.x0 and abs(a.y0 - b.y0) = 4.5e0) or (a.y0 = b.y0 and abs(a.x0 - b.x0) = 8e0))""")
def _(v):
    k, i = F.col("n_nationkey"), F.col("vertex")
    tiles = v.table("nation").withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        k.alias("id"), F.lit(0).alias("ring"), "vertex",
        (66.0 + 8.0 * (k % 5) + F.when(i.isin(1, 2), 8.0).otherwise(0.0)).alias("x"),
        (25.0 + 4.5 * F.floor(k / 5.0) + F.when(i.isin(2, 3), 4.5).otherwise(0.0)).alias("y"),
    )
    return rounded(sp.share_edge(tiles))


def _reference(v):
    return v.runs.groupBy("rgi_id").agg(F.avg(F.col("volume") / F.col("area")).alias("smb"))


@query("J16_join_reference", f"""with m as (select rgi_id, avg(volume / area) as smb from runs group by 1)
select m.rgi_id, {R('m.smb')} as smb, {R('g.dmdtda')} as dmdtda, g.area, g.is_cor, g.region from m join geodetic g on m.rgi_id = g.rgi_id where not g.is_cor""")
def _(v):
    return rounded(sp.join_reference(_reference(v), v.geodetic))


@query("J16b_join_reference_fallback", f"""with m as (select rgi_id, avg(volume / area) as smb from runs group by 1)
select m.rgi_id, {R('m.smb')} as smb, {R('g.dmdtda')} as dmdtda, g.area, g.is_cor, g.region from m join geodetic g on m.rgi_id = g.rgi_id where g.is_cor""")
def _(v):
    # only corrected rows are left, so the fallback has to use them
    return rounded(sp.join_reference(_reference(v), v.geodetic.where("is_cor")))


@query("S14_flatten_grid", f"""select {R('lon')} as lon, {R('lat')} as lat, obs_date, {R('dh')} as dh from fp
where lon between 75 and 90 and lat between 28 and 36 and obs_date between date '1997-01-01' and date '1998-12-31'""")
def _(v):
    grid = v.fp.select("lon", "lat", "obs_date", "dh", F.col("track").alias("expver"))
    return rounded(scans.flatten_grid(grid, (75.0, 28.0, 90.0, 36.0), "1997-01-01", "1998-12-31", ["dh"], time="obs_date"))
