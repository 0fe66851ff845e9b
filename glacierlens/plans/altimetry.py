"""Queries on footprints: robust statistics, windows, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.operators import altimetry as alt
from glacierlens.operators import lattice
from glacierlens.operators import timewindows as tw
from glacierlens.plans.fixtures import END, REF_DATE, START
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R, mid, robust, se, windowed

SPAN = (START, END, REF_DATE)


def _windows(v, *kinds):
    win = tw.annual_windows(v.spark, *SPAN)
    win = win.where(F.col("win_kind").isin(*kinds)) if kinds else win
    return lambda df: tw.month_join(df, win, REF_DATE)


def flagship(v):
    """Annual, multi-year robust statistics for all region hierarchies."""
    rows = alt.with_cell(tw.with_month(alt.qc_height_change(v.fp, 200.0), REF_DATE))
    levels = [(alt.hierarchies, ["hier", "region_id", "month"]), (_windows(v), ["hier", "region_id", "win_kind", "win_id"])]
    return rounded(lattice.robust_stats(rows, ["month", *alt.finest()], levels, alt.PHOTON))


query(
    "A09_annual_multi_stats",
    robust(windowed("win_year", "hfp").replace("from hfp f", "from (select * from hfp where abs(dh) <= 200) f"),
           "hier, region_id, win_kind, win_id", 150, 75, 101, True),
)(flagship)


@query("A01_robust_stats_i2", robust("fp", "region22", 150, 75, 101, True))
def _(v):
    return rounded(alt.robust_stats(v.fp, ["region22"], alt.PHOTON))


@query("A02_robust_stats_i1", robust("fp", "region22", 100, 50, 1, False))
def _(v):
    return rounded(alt.robust_stats(v.fp, ["region22"], alt.LASER))


@query("A03_robust_stats_cell_i1", robust("cfp", "cell", 100, 50, 10, False))
def _(v):
    return rounded(alt.robust_stats(alt.with_cell(v.fp), ["cell"], alt.LASER_CELL))


@query("A04_robust_stats_c2", robust("fp", "region15, tp_flag", 150, 75, 30, False, flag=False))
def _(v):
    return rounded(alt.robust_stats(v.fp, ["region15", "tp_flag"], alt.RADAR))


@query(
    "A05_summary10",
    f"""with base as (select *, cast(year(obs_date) as int) as yr from fp where slope_deg <= 40),
med as (select region15, yr, median(dh) as med, count(*) as n_first from base where abs(dh) < 150 group by 1, 2)
select b.region15, b.yr, m.n_first, count(*) as n, {R('avg(dh)')} as mean,
  {R('coalesce(stddev_samp(dh), 0e0)')} as sd, {R(se('dh'))} as se, {R('min(dh)')} as min, {R('max(dh)')} as max,
  {R(mid('dh', 0.25))} as p25, {R(mid('dh', 0.5))} as median, {R(mid('dh', 0.75))} as p75
from base b join med m on b.region15 = m.region15 and b.yr = m.yr
where abs(dh - med) < 75 group by 1, 2, 3""",
)
def _(v):
    rows = v.fp.withColumn("yr", F.year("obs_date"))
    return rounded(alt.summary10(rows, ["region15", "yr"], alt.RADAR))


@query("A06_multi_hierarchy", robust("hfp", "hier, region_id", 150, 75, 101, True))
def _(v):
    levels = [(alt.hierarchies, ["hier", "region_id"])]
    return rounded(lattice.robust_stats(alt.with_cell(v.fp), alt.finest(), levels, alt.PHOTON))


@query(
    "A07_percentile_bounds",
    f"""with t as (select 'all' as hier, 0 as region_id, dh from fp union all select 'r22', region22, dh from fp)
select hier, region_id, count(*) as n, {R(mid('dh', 0.01))} as low, {R(mid('dh', 0.99))} as high,
  {R(mid('dh', 0.5))} as median from t group by 1, 2""",
)
def _(v):
    tagged = alt.hierarchies(v.fp, ("all", "r22"))
    return rounded(alt.percentile_bounds(tagged, ["hier", "region_id"], 1.0))


@query("A08_monthly_stats", robust(windowed("win_month"), "region15, win_kind, win_id", 150, 75, 30, False, flag=False))
def _(v):
    rows = tw.window_join(v.fp, tw.monthly_windows(v.spark, *SPAN), REF_DATE)
    return rounded(alt.robust_stats(rows, ["region15", "win_kind", "win_id"], alt.RADAR))


@query("A10_seasonal_stats", robust(windowed("win_season"), "region15, win_kind, win_id", 150, 75, 101, True))
def _(v):
    rows = tw.window_join(v.fp, tw.seasonal_windows(v.spark, *SPAN), REF_DATE)
    return rounded(alt.robust_stats(rows, ["region15", "win_kind", "win_id"], alt.PHOTON))


_YEARS = "(select unnest(generate_series(1995, 2001)) as y)"
_CENTRED = f"""(select 'centred3' as win_kind, cast(y as int) as win_id,
  date_diff('day', date '1995-01-01', make_date(y - 1, 1, 1)) as start_day,
  date_diff('day', date '1995-01-01', make_date(y + 2, 1, 1)) as end_day from {_YEARS})"""
_OVERLAP = f"""(select 'overlap21' as win_kind, cast(y as int) as win_id,
  date_diff('day', date '1995-01-01', make_date(y, 1, 1)) as start_day,
  date_diff('day', date '1995-01-01', make_date(y + 1, 10, 1)) as end_day from {_YEARS})"""
_CAMPAIGNS = "(values " + ", ".join(
    f"('campaign', {i + 1}, date_diff('day', date '1995-01-01', cast(date '{a}' - interval 8 year as date)), "
    f"date_diff('day', date '1995-01-01', cast(date '{b}' - interval 8 year as date)) + 1)"
    for i, (a, b) in enumerate(tw.CAMPAIGNS)
) + ") w(win_kind, win_id, start_day, end_day)"


@query("A11_centred_3yr_stats", robust(windowed(_CENTRED), "region22, win_kind, win_id", 100, 50, 1, False))
def _(v):
    rows = tw.window_join(v.fp, tw.centred_windows(v.spark, *SPAN), REF_DATE)
    return rounded(alt.robust_stats(rows, ["region22", "win_kind", "win_id"], alt.LASER))


@query("A12_annual_overlap_stats", robust(windowed(_OVERLAP), "region22, win_kind, win_id", 100, 50, 1, False))
def _(v):
    rows = tw.window_join(v.fp, tw.overlap_windows(v.spark, *SPAN), REF_DATE)
    return rounded(alt.robust_stats(rows, ["region22", "win_kind", "win_id"], alt.LASER))


@query(
    "A13_campaign_stats",
    robust(windowed(_CAMPAIGNS).replace(") w(win_kind, win_id, start_day, end_day) w on", ") w(win_kind, win_id, start_day, end_day) on"),
           "region15, win_kind, win_id", 100, 50, 1, False),
)
def _(v):
    # the campaigns moved into the years of the fixture footprints
    win = tw.campaign_windows(v.spark, REF_DATE, shift_months=-96)
    rows = tw.window_join(v.fp, win, REF_DATE)
    return rounded(alt.robust_stats(rows, ["region15", "win_kind", "win_id"], alt.LASER))


@query(
    "A14_cell_stats",
    robust(
        "(select * from " + windowed("win_year", "cfp") + " where win_kind in ('y1', 'y3', 'all'))",
        "cell, win_kind, win_id", 150, 75, 1, True,
    ).replace("select m.cell,", "select m.cell, m.cell // 1000 + 0.5e0 as center_lon, m.cell % 1000 + 0.5e0 as center_lat,"),
)
def _(v):
    rows = alt.with_cell(tw.with_month(v.fp, REF_DATE))
    levels = [(_windows(v, "y1", "y3", "all"), ["cell", "win_kind", "win_id"])]
    out = lattice.robust_stats(rows, ["month", "cell"], levels, alt.PHOTON_CELL)
    return rounded(
        out.withColumn("center_lon", F.floor(F.col("cell") / 1000) + 0.5)
        .withColumn("center_lat", F.col("cell") % 1000 + 0.5)
    )


_BANDS = f"""select hier, region_id, win_id, cast(2250 + 100 * floor((elev_ref - 2200) / 100e0) as int) as band_center,
  avg(dh) as mean, count(*) as n, {se('dh')} as se
from {windowed('win_year', 'hfp', "and w.win_kind = 'y1'")}
where slope_deg <= 40 and quality_flag = 0 and abs(dh) < 120 and elev_ref >= 2200 and elev_ref < 8800
group by 1, 2, 3, 4"""


def _bands(v, wanted=alt.HIERARCHIES):
    rows = alt.in_bands(alt.with_cell(tw.with_month(v.fp, REF_DATE)), cut=120.0)
    year = _windows(v, "y1")
    levels = [(lambda df: alt.hierarchies(year(df), wanted), ["hier", "region_id", "win_id", "band_center"])]
    return lattice.band_stats(rows, ["month", "band_center", *alt.finest(wanted)], levels)


@query(
    "A15_band_stats",
    f"select hier, region_id, win_id, band_center, {R('mean')} as mean, n, {R('se')} as se from ({_BANDS})",
)
def _(v):
    return rounded(_bands(v))


@query(
    "A15b_band_stats_laser",
    f"""select region22, win_id, cast(2250 + 100 * floor((elev_ref - 2200) / 100e0) as int) as band_center,
  {R('avg(dh)')} as mean, count(*) as n, {R(se('dh'))} as se
from {windowed(_CAMPAIGNS).replace(") w(win_kind, win_id, start_day, end_day) w on", ") w(win_kind, win_id, start_day, end_day) on")}
where slope_deg < 40 and abs(dh) < 100 and elev_ref >= 2200 and elev_ref < 8800 group by 1, 2, 3""",
)
def _(v):
    win = tw.campaign_windows(v.spark, REF_DATE, shift_months=-96)
    rows = tw.window_join(v.fp, win, REF_DATE)
    return rounded(alt.band_stats(rows, ["region22", "win_id"], cut=100.0, strict_slope=True, flag=None))


def _weighted_sql(keep: str) -> str:
    return f"""with bands as ({_BANDS})
select b.region_id, b.win_id, {R('sum(a.area * b.mean) / sum(a.area)')} as value, cast(sum(b.n) as bigint) as n,
  {R('avg(b.se) / sqrt(count(*))')} as se
from bands b join band_area a on a.band_center = b.band_center and a.region_id = b.region_id
where b.hier = 'r22' and {keep} group by 1, 2 having sum(a.area) > 0"""


def _weighted(v, mission):
    bands = _bands(v, ("r22",))
    return rounded(alt.area_weighted(bands, v.band_area, ["region_id", "win_id"], mission))


@query("A16_area_weighted", _weighted_sql("b.n >= 10 and abs(b.mean) <= 50 and abs(b.mean) > 0"))
def _(v):
    return _weighted(v, "photon")


@query("A16b_area_weighted_laser", _weighted_sql("not (b.n < 20 and abs(b.mean) > 60)"))
def _(v):
    return _weighted(v, "laser")


@query("A16c_area_weighted_radar", _weighted_sql("not (b.n < 10 and abs(b.mean) > 60)"))
def _(v):
    return _weighted(v, "radar")


@query(
    "A17_trimmed_mean",
    f"""with b as (select region22, {mid('dh', 0.05)} as lo, {mid('dh', 0.95)} as hi from fp group by 1)
select f.region22, {R('avg(dh)')} as mean, {R('coalesce(stddev_samp(dh), 0e0)')} as sd, count(*) as n
from fp f join b on f.region22 = b.region22 where dh between lo and hi group by 1""",
)
def _(v):
    return rounded(alt.trimmed_mean(v.fp, ["region22"], "dh", 5.0))


@query(
    "A18_sigma_filter",
    f"""with s as (select region22, avg(dh) as m, stddev_samp(dh) as s from fp group by 1)
select f.region22, f.track, f.obs_day, {R('f.lon')} as lon, {R('f.lat')} as lat, {R('f.dh')} as dh
from fp f join s on f.region22 = s.region22 where abs(f.dh - s.m) <= 1.5e0 * s.s""",
)
def _(v):
    rows = v.fp.select("region22", "track", "obs_day", "lon", "lat", "dh")
    return rounded(alt.sigma_filter(rows, ["region22"], "dh", 1.5))


@query(
    "A19_median_filter",
    f"""with s as (select region22, median(dh) as m from fp group by 1)
select f.region22, f.track, f.obs_day, {R('f.lon')} as lon, {R('f.lat')} as lat, {R('f.dh')} as dh
from fp f join s on f.region22 = s.region22 where abs(f.dh - s.m) < 75""",
)
def _(v):
    rows = v.fp.select("region22", "track", "obs_day", "lon", "lat", "dh")
    return rounded(alt.median_filter(rows, ["region22"], "dh", 75.0))


_ITEMS = {
    "n_total": "max((select count(*) from fp))", "n_kept": "count(*)",
    "kept_percent": "100e0 * count(*) / max((select count(*) from fp))",
    "valid_months": "count(distinct year(obs_date) * 12 + month(obs_date))",
    "dh_p01": mid("dh", 0.01), "dh_p99": mid("dh", 0.99), "lon_min": "min(lon)", "lon_max": "max(lon)",
    "lat_min": "min(lat)", "lat_max": "max(lat)", "elev_min": "min(elev_ref)", "elev_max": "max(elev_ref)",
}


@query(
    "A52_qc_report",
    " union all ".join(
        f"select '{k}' as item, {R(f'cast({e} as double)')} as value from fp where abs(dh) <= 200"
        for k, e in _ITEMS.items()
    ),
)
def _(v):
    return rounded(alt.qc_report(v.fp, 200.0))
