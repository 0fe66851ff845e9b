"""Queries on scans, sinks and streams.

Each one first writes the given tables into a fresh folder below the shared
folder, in the layout the scan or the stream expects, and reads that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glacierlens.operators import altimetry as alt
from glacierlens.operators import timewindows as tw
from glacierlens.plans.altimetry import _BANDS
from glacierlens.plans.fixtures import END, REF_DATE, START
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R, inside, robust
from glacierlens.session import scratch_path
from glacierlens.sources import scans, sinks
from glacierlens.streaming import ingest


@query("S01_read_footprints", f"""select track, {R('lon')} as lon, {R('lat')} as lat, {R('case when slope_deg > 45 then null else dh + elev_ref end')} as h_obs,
  {R('lat / 10e0')} as geoid, quality_flag as quality, date_diff('day', date '2000-01-01', obs_date) as obs_day, obs_date from fp""")
def _(v):
    path = scratch_path(v.spark, "footprints")
    nan = F.lit(float("nan"))
    raw = v.fp.select(
        "track", "lon", "lat", (F.date_diff("obs_date", F.lit("2000-01-01").cast("date")) * 86400.0 + 30000.0).alias("seconds"),
        F.when(F.col("slope_deg") > 45, nan).otherwise(F.col("dh") + F.col("elev_ref")).alias("h_obs"),
        (F.col("lat") / 10.0).alias("geoid"), F.col("quality_flag").cast("double").alias("quality"),
    )
    raw.write.parquet(path)
    return rounded(scans.read_footprints(v.spark, path, "laser"))


@query("S02_scan_dated", f"""select cast(ts as date) as file_date, count(*) as n, {R('sum(value)', 4)} as total from events group by 1""")
def _(v):
    path = scratch_path(v.spark, "dated")
    e = v.table("events").withColumn("day", F.to_date("ts"))
    e.write.partitionBy("day").parquet(path)
    rows = scans.scan_dated(v.spark, path, r"day=(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd")
    return rounded(rows.groupBy("file_date").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("S03_scan_many", f"select event_id, user_id, event_type, {R('value')} as value from events")
def _(v):
    e = v.table("events").select("event_id", "user_id", "event_type", "value")
    paths = [scratch_path(v.spark, f"part{i}") for i in (0, 1)]
    for i, p in enumerate(paths):
        e.where(F.col("event_id") % 2 == i).write.parquet(p)
    return rounded(scans.scan_many(v.spark, paths))


@query("S06_write_results", f"""with s as ({robust('fp', 'region22', 150, 75, 101, True)})
select region22, 'mean' as measure, mean as value from s union all select region22, 'n', cast(n as double) from s union all select region22, 'se', se from s""")
def _(v):
    path = scratch_path(v.spark, "results")
    sinks.write_results(rounded(alt.robust_stats(v.fp, ["region22"], alt.PHOTON)), path, ["region22"])
    return v.spark.read.parquet(path)


@query("S07_write_by_region", f"select hier, region_id, win_id, band_center, {R('mean')} as mean, n, {R('se')} as se from ({_BANDS}) where hier in ('r15', 'tp')")
def _(v):
    path = scratch_path(v.spark, "regions")
    # the output has one folder for each region, here of two region sets
    win = tw.annual_windows(v.spark, START, END, REF_DATE).where(F.col("win_kind") == "y1")
    tags = alt.hierarchies(v.fp.where(alt.PHOTON.base()), ("r15", "tp"))
    bands = alt.band_stats(tw.window_join(tags, win, REF_DATE), ["hier", "region_id", "win_id"], cut=120.0)
    sinks.write_by_region(rounded(bands), path)
    return v.spark.read.parquet(path)


@query("S08_append_by_cell", f"""select cast(floor(lat) as int) as lat_cell, cast(floor(lon) as int) as lon_cell, count(*) as n_rows, {R('sum(dh)', 4)} as dh, count(*) as n_saved from fp group by 1, 2""")
def _(v):
    path = scratch_path(v.spark, "cells")
    rows = v.fp.select("track", "obs_day", "lon", "lat", "dh")
    # the second append runs twice, as after a failure that came too late
    for part, name in ((F.col("lat") < 36, "south"), (F.col("lat") >= 36, "north"), (F.col("lat") >= 36, "north")):
        sinks.append_once(rows.where(part), path, name)
    back = sinks.read_committed(v.spark, path, rows.schema).groupBy("lat_cell", "lon_cell").agg(F.count("*").alias("n_rows"), F.sum("dh").alias("dh"))
    return rounded(back.join(sinks.saved_rows(rows), ["lat_cell", "lon_cell"]), 4)


@query("S12_merge_batches", f"select rgi_id, yr, {R('sum(volume)')} as volume from runs group by 1, 2 order by 1")
def _(v):
    path = scratch_path(v.spark, "batches")
    t = v.runs.groupBy("rgi_id", "yr").agg(F.sum("volume").alias("volume"))
    for i in range(3):
        t.where(F.col("rgi_id") % 3 == i).write.parquet(f"{path}/run_batch_{i}")
    t.write.parquet(f"{path}/run_all")
    return rounded(scans.merge_batches(v.spark, path, "rgi_id"))


_OFF = inside("p.lon", "p.lat", "p", "p.lon, p.lat").replace("join edge e on true", "join (select * from edge where id % 2 = 1) e on true")


@query("R01_stream_footprints", f"""with big as (select track, year(obs_date) as y from fp group by 1, 2 having count(*) > 1400),
p as (select distinct lon, lat from fp), t as (select distinct lon, lat from {_OFF})
select cast(floor(fp.lat) as int) as lat_cell, cast(floor(fp.lon) as int) as lon_cell, count(*) as n, {R('sum(dh)', 4)} as dh
from fp join big on fp.track = big.track and year(fp.obs_date) = big.y left join t on fp.lon = t.lon and fp.lat = t.lat where t.lon is null group by 1, 2""")
def _(v):
    src, out, chk = (scratch_path(v.spark, n) for n in ("granules", "off_ice", "progress"))
    rows = v.fp.select("track", "obs_day", "lon", "lat", "dh", F.concat_ws("-", "track", F.year("obs_date")).alias("granule"))
    rows.repartition("granule").write.partitionBy("granule").parquet(src)
    schema = rows.drop("granule").schema
    # every second rectangle, so that some points lie outside all
    polys = v.hpoly.where(F.col("id") % 2 == 1)
    ingest.stream_footprints(v.spark, src, schema, polys, out, chk, min_rows=1400).awaitTermination()
    return rounded(
        ingest.read_off_ice(v.spark, out, schema).groupBy("lat_cell", "lon_cell")
        .agg(F.count("*").alias("n"), F.sum("dh").alias("dh")), 4
    )


@query("R02_stream_daily_climate", f"""with d as (select user_id as glacier_id, event_type as variable, cast(ts as date) as obs_date, avg(value) as value from events group by 1, 2, 3)
select glacier_id, variable, cast(date_trunc('month', obs_date) as date) as month, {R('avg(value)')} as value, count(value) as n_days from d group by 1, 2, 3""")
def _(v):
    src, out, chk = (scratch_path(v.spark, n) for n in ("readings", "store", "progress"))
    e = v.table("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("glacier_id"), F.col("event_type").alias("variable"), "value"
    )
    e.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(src)
    ingest.stream_daily_climate(v.spark, src, out, chk).awaitTermination()
    return rounded(ingest.monthly_from_store(v.spark, out))
