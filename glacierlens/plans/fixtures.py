"""Fixture views over the given tables, in Spark and as DuckDB text.

The Spark side is lazy DataFrame code, the SQL side a set of common table
expressions that the registry puts in front of each oracle that names them.
Dates count from 1995-01-01, the reference date of the fixture footprints.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


REF_DATE = "1995-01-01"
START, END = "1995-01-01", "2002-01-01"


class Views:
    """Lazily built fixture views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, gaps: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.gaps = gaps

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        return self.table("lineitem").join(
            self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
        )

    @cached_property
    def fp(self) -> DataFrame:
        return self._footprints(self._lines)

    def _footprints(self, lines: DataFrame) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        return lines.join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).select(
            F.concat("l_returnflag", "l_linestatus").alias("track"),
            (66.0 + ((F.col("l_partkey") * 7) % 4000) / 100.0).alias("lon"),
            (25.0 + ((F.col("l_suppkey") * 13 + F.col("l_partkey")) % 2200) / 100.0).alias("lat"),
            F.date_diff(day, F.lit(REF_DATE).cast("date")).alias("obs_day"),
            day.alias("obs_date"),
            (2200 + (F.col("l_partkey") * 37) % 6600).cast("double").alias("elev_ref"),
            ((F.col("l_extendedprice") - 45000) / 250.0).alias("dh"),
            (F.col("l_tax") * 600).alias("slope_deg"),
            F.when(F.col("l_discount") >= 0.095, 1).otherwise(0).alias("quality_flag"),
            F.col("s_nationkey").alias("region22"),
            F.col("n_regionkey").alias("region15"),
            F.when(F.col("s_nationkey") < 8, 1).otherwise(0).alias("tp_flag"),
        )

    @cached_property
    def gl(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("glacier_id"),
            F.col("s_name").alias("name"),
            (66.0 + (k * 131 % 4000) / 100.0).alias("cen_lon"),
            (25.0 + (k * 97 % 2200) / 100.0).alias("cen_lat"),
            (0.05 + (k * 7919 % 10000) / 500.0).alias("area_km2"),
            F.col("s_nationkey").alias("region22"),
            (3500 + k * 31 % 2500).cast("double").alias("ref_hgt"),
        )

    @cached_property
    def dly(self) -> DataFrame:
        reading = F.when(F.col("l_tax") >= 0.075, None).otherwise(F.col("l_extendedprice") / 1000.0)
        return self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("glacier_id"),
            F.col("l_returnflag").alias("variable"),
            F.col("l_shipdate").cast("date").alias("obs_date"),
        ).agg(F.avg(reading).alias("value"))

    def _with_gaps(self, df: DataFrame) -> DataFrame:
        """Missing months as climate files have them, where wanted: single ones, and a whole year of one glacier."""
        if not self.gaps:
            return df
        g, yr, mo = F.col("glacier_id"), F.col("yr"), F.col("mo")
        year = (g == 3) & (yr == 1996)
        return df.withColumns({
            "temp": F.when(~(year | ((g * 5 + yr * 3 + mo * 7) % 61 == 0)), F.col("temp")),
            "prcp": F.when(~(year | ((g * 3 + yr * 7 + mo * 5) % 67 == 0)), F.col("prcp")),
        })

    @cached_property
    def mon(self) -> DataFrame:
        return self._with_gaps(self._lines.groupBy(
            F.col("s_nationkey").alias("glacier_id"),
            F.year("l_shipdate").alias("yr"),
            F.month("l_shipdate").alias("mo"),
        ).agg(
            (F.avg("l_quantity") - 27.0).alias("temp"),
            (F.avg("l_extendedprice") / 500.0).alias("prcp"),
        ))

    @cached_property
    def ens(self) -> DataFrame:
        return self._with_gaps(self._lines.groupBy(
            F.col("s_nationkey").alias("glacier_id"),
            F.col("l_returnflag").alias("gcm"),
            F.col("l_linestatus").alias("ssp"),
            F.year("l_shipdate").alias("yr"),
            F.month("l_shipdate").alias("mo"),
        ).agg(
            (F.avg("l_quantity") - 25.0).alias("temp"),
            (F.avg("l_extendedprice") / 450.0).alias("prcp"),
        ))

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).groupBy(
            (F.col("c_nationkey") * 10 + F.col("o_custkey") % 10).alias("rgi_id"),
            F.col("o_orderstatus").alias("gcm"),
            F.substring("o_orderpriority", 1, 1).alias("ssp"),
            F.year("o_orderdate").alias("yr"),
        ).agg(
            (F.sum("o_totalprice") / 1e3).alias("volume"),
            (1.0 + F.count("*")).alias("area"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        t = F.col("temp")
        s = F.when(t >= 0.5, 4).when(t >= 0, 2).when(t >= -1, 1).otherwise(0)
        return self.mon.groupBy("glacier_id", "yr").agg(F.sum(s).alias("score"))

    @cached_property
    def bins(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            (k % 25).alias("glacier_id"),
            k.alias("bin_id"),
            (2500 + F.col("p_size") * 60).cast("double").alias("height"),
            (F.col("p_retailprice") / 10.0).alias("width"),
        )

    @cached_property
    def band_area(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").groupBy(
            (2250 + 100 * (k % 66)).alias("band_center"), (k % 25).alias("region_id")
        ).agg((F.sum("p_retailprice") / 100.0).alias("area"))

    @cached_property
    def poly(self) -> DataFrame:
        k = F.col("n_nationkey")
        v = F.col("vertex")
        return self.table("nation").withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
            k.alias("id"),
            F.col("n_regionkey").alias("parent"),
            "vertex",
            (66.0 + 8.0 * (k % 5) + F.when(v.isin(1, 2), 8.5).otherwise(0.0)).alias("x"),
            (25.0 + 4.4 * F.floor(k / 5.0) + F.when(v.isin(2, 3), 4.9).otherwise(0.0)).alias("y"),
        )

    @cached_property
    def geodetic(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("rgi_id"),
            F.col("c_nationkey").alias("region"),
            (F.col("c_acctbal") / 10000.0 - 0.5).alias("dmdtda"),
            (1e5 + (k * 7919 % 1000) * 1e4).alias("area"),
            (k % 11 == 0).alias("is_cor"),
        )

    @cached_property
    def px(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("r"),
            (F.col("label") < 7).alias("mask"),
            F.posexplode("embedding").alias("c", "v"),
        ).select("r", "c", F.col("v").cast("double").alias("value"), "mask")

    @cached_property
    def obs_mb(self) -> DataFrame:
        """Observed annual balances, one series per glacier of ``mon``."""
        return self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        ).groupBy(F.col("c_nationkey").alias("glacier_id"), F.year("o_orderdate").alias("yr")).agg(
            (F.avg("o_totalprice") / 100.0 - 2500.0).alias("mb")
        )

    @cached_property
    def pts(self) -> DataFrame:
        """Grid points with a running index, an irregular half-degree subset."""
        k = F.col("p_partkey")
        return self.table("part").groupBy(
            (66.0 + (k * 7 % 81) * 0.5).alias("lon"), (25.0 + (k * 11 % 45) * 0.5).alias("lat")
        ).agg(F.min("p_partkey").alias("idx"))


    @cached_property
    def cells(self) -> DataFrame:
        """Attributes of the 1-degree cells; about half of the cells have a row."""
        k = F.col("c_custkey")
        return self.table("customer").groupBy(
            (66 + k % 40).cast("double").alias("cell_lon"), (25 + k * 3 % 22).cast("double").alias("cell_lat")
        ).agg((F.avg("c_acctbal") / 1000.0).alias("pdd"), (F.min("c_acctbal") / 2000.0).alias("vshift"))

    @cached_property
    def fpx(self) -> DataFrame:
        """Footprints before the height change is computed."""
        geoid = 30 + F.col("lat") / 10.0
        return self.fp.select(
            "track", "lon", "lat", "obs_day", "elev_ref", geoid.alias("geoid"),
            (F.col("dh") + F.col("elev_ref") + geoid).alias("h_obs"),
            (F.col("obs_day") % 4).alias("sat_flag"), (F.col("slope_deg") / 100.0).alias("sat_corr"),
        )

    @cached_property
    def par(self) -> DataFrame:
        """Calibrated parameters, one row per glacier of ``mon`` and ``bins``."""
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.alias("glacier_id"), (3800 + k * 20).cast("double").alias("ref_hgt"),
            (90.0 + k * 2.5).alias("mu"), ((k % 3) * 50).cast("double").alias("bias"),
        )

    @cached_property
    def hpoly(self) -> DataFrame:
        """The rectangles as rings of one hierarchy."""
        return self.poly.select(
            F.lit("r22").alias("hier"), F.col("id").cast("long").alias("id"), F.lit(0).alias("ring"), "vertex", "x", "y"
        )


SQL_VIEWS: dict[str, str] = {
    "fp": """select concat(l_returnflag, l_linestatus) as track,
  66e0 + ((l_partkey * 7) % 4000) / 100e0 as lon,
  25e0 + ((l_suppkey * 13 + l_partkey) % 2200) / 100e0 as lat,
  date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as obs_day,
  cast(l_shipdate as date) as obs_date,
  cast(2200 + (l_partkey * 37) % 6600 as double) as elev_ref,
  (l_extendedprice - 45000) / 250e0 as dh,
  l_tax * 600 as slope_deg,
  case when l_discount >= 0.095e0 then 1 else 0 end as quality_flag,
  s_nationkey as region22, n_regionkey as region15,
  case when s_nationkey < 8 then 1 else 0 end as tp_flag
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "gl": """select s_suppkey as glacier_id, s_name as name,
  66e0 + (s_suppkey * 131 % 4000) / 100e0 as cen_lon, 25e0 + (s_suppkey * 97 % 2200) / 100e0 as cen_lat,
  0.05e0 + (s_suppkey * 7919 % 10000) / 500e0 as area_km2, s_nationkey as region22,
  cast(3500 + s_suppkey * 31 % 2500 as double) as ref_hgt
from supplier""",
    "dly": """select l_suppkey as glacier_id, l_returnflag as variable, cast(l_shipdate as date) as obs_date,
  avg(case when l_tax >= 0.075e0 then null else l_extendedprice / 1000e0 end) as value
from lineitem group by 1, 2, 3""",
    "mon": """select s_nationkey as glacier_id, cast(year(l_shipdate) as int) as yr, cast(month(l_shipdate) as int) as mo,
  avg(l_quantity) - 27e0 as temp, avg(l_extendedprice) / 500e0 as prcp
from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3""",
    "ens": """select s_nationkey as glacier_id, l_returnflag as gcm, l_linestatus as ssp,
  cast(year(l_shipdate) as int) as yr, cast(month(l_shipdate) as int) as mo,
  avg(l_quantity) - 25e0 as temp, avg(l_extendedprice) / 450e0 as prcp
from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3, 4, 5""",
    "runs": """select c_nationkey * 10 + o_custkey % 10 as rgi_id, o_orderstatus as gcm,
  substr(o_orderpriority, 1, 1) as ssp, cast(year(o_orderdate) as int) as yr,
  sum(o_totalprice) / 1e3 as volume, 1e0 + count(*) as area
from orders join customer on o_custkey = c_custkey group by 1, 2, 3, 4""",
    "scores": """select glacier_id, yr, cast(sum(case when temp >= 0.5e0 then 4 when temp >= 0 then 2
  when temp >= -1 then 1 else 0 end) as bigint) as score from mon group by 1, 2""",
    "bins": """select p_partkey % 25 as glacier_id, p_partkey as bin_id,
  cast(2500 + p_size * 60 as double) as height, p_retailprice / 10e0 as width from part""",
    "band_area": """select 2250 + 100 * (p_partkey % 66) as band_center, p_partkey % 25 as region_id,
  sum(p_retailprice) / 100e0 as area from part group by 1, 2""",
    "poly": """select n_nationkey as id, n_regionkey as parent, v.i as vertex,
  66e0 + 8e0 * (n_nationkey % 5) + case when v.i in (1, 2) then 8.5e0 else 0e0 end as x,
  25e0 + 4.4e0 * floor(n_nationkey / 5e0) + case when v.i in (2, 3) then 4.9e0 else 0e0 end as y
from nation cross join (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4) v""",
    "geodetic": """select c_custkey as rgi_id, c_nationkey as region, c_acctbal / 10000e0 - 0.5e0 as dmdtda,
  1e5 + (c_custkey * 7919 % 1000) * 1e4 as area, (c_custkey % 11 = 0) as is_cor from customer""",
    "px": """select vec_id as r, cast(i - 1 as int) as c, cast(embedding[i] as double) as value, label < 7 as mask
from embeddings, range(1, 65) t(i)""",
    "obs_mb": """select c_nationkey as glacier_id, cast(year(o_orderdate) as int) as yr,
  avg(o_totalprice) / 100e0 - 2500e0 as mb from orders join customer on o_custkey = c_custkey group by 1, 2""",
    "pts": """select 66e0 + (p_partkey * 7 % 81) * 0.5e0 as lon, 25e0 + (p_partkey * 11 % 45) * 0.5e0 as lat,
  min(p_partkey) as idx from part group by 1, 2""",
    "cells": """select cast(66 + c_custkey % 40 as double) as cell_lon, cast(25 + c_custkey * 3 % 22 as double) as cell_lat,
  avg(c_acctbal) / 1000e0 as pdd, min(c_acctbal) / 2000e0 as vshift from customer group by 1, 2""",
    "fpx": """select track, lon, lat, obs_day, elev_ref, 30 + lat / 10e0 as geoid,
  dh + elev_ref + (30 + lat / 10e0) as h_obs, obs_day % 4 as sat_flag, slope_deg / 100e0 as sat_corr from fp""",
    "fpc": """select f.*, coalesce(c.pdd, 0e0) as pdd, coalesce(c.vshift, 0e0) as vshift from fpx f
  left join cells c on floor(f.lon) = c.cell_lon and floor(f.lat) = c.cell_lat""",
    "edge": """select a.id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from poly a join poly b on a.id = b.id and b.vertex = a.vertex + 1""",
    "par": """select n_nationkey as glacier_id, cast(3800 + n_nationkey * 20 as double) as ref_hgt,
  90e0 + n_nationkey * 2.5e0 as mu, cast((n_nationkey % 3) * 50 as double) as bias from nation""",
    "pt": """select c.glacier_id, c.yr, c.mo, b.bin_id, b.height, b.width, p.mu, p.bias, c.t as temp, c.p as prcp,
  case when c.t <= -1 then 0 else c.t + 1 end as melt, c.p * case when c.t <= 0 then 1 when c.t >= 2 then 0 else 1 - c.t / 2e0 end as snow
from (select m.glacier_id, m.yr, m.mo, b.bin_id, m.temp - 0.0065e0 * (b.height - p.ref_hgt) as t, m.prcp * 2.5e0 as p
  from mon m join par p on m.glacier_id = p.glacier_id join bins b on m.glacier_id = b.glacier_id) c
join bins b on c.bin_id = b.bin_id join par p on c.glacier_id = p.glacier_id""",
    # calendar windows, days relative to 1995-01-01, half-open
    "win_year": """select k.win_kind, cast(year(d.s) as int) as win_id,
  date_diff('day', date '1995-01-01', cast(d.s as date)) as start_day,
  date_diff('day', date '1995-01-01', cast(d.s + to_months(k.n) as date)) as end_day
from (select 'y1' as win_kind, 12 as n union all select 'y2', 24 union all select 'y3', 36 union all select 'all', 84) k,
  (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-01-01', interval 1 year)) as s) d
where d.s + to_months(k.n) <= timestamp '2002-01-01'""",
    "win_month": """select 'month' as win_kind, cast(year(s) * 100 + month(s) as int) as win_id,
  date_diff('day', date '1995-01-01', cast(s as date)) as start_day,
  date_diff('day', date '1995-01-01', cast(s + interval 1 month as date)) as end_day
from (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-01', interval 1 month)) as s)""",
    "win_season": """select 'season' as win_kind, cast(year(s) * 100 + month(s) as int) as win_id,
  date_diff('day', date '1995-01-01', cast(s as date)) as start_day,
  date_diff('day', date '1995-01-01', cast(s + interval 3 month as date)) as end_day
from (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-10-01', interval 1 month)) as s)""",
    "hfp": """select f.*, h.hier, h.region_id from fp f, lateral (
  select 'all' as hier, 0 as region_id
  union all select 'r15', f.region15
  union all select 'r22', f.region22
  union all select 'tp', 0 where f.tp_flag = 1
  union all select 'cell', cast(floor(f.lon) * 1000 + floor(f.lat) as int)) h""",
    "cfp": "select f.*, cast(floor(lon) * 1000 + floor(lat) as int) as cell from fp f",
}

_NEEDS = {
    "scores": ["mon"], "hfp": ["fp"], "cfp": ["fp"], "fpx": ["fp"], "fpc": ["fpx", "fp", "cells"], "edge": ["poly"], "pt": ["mon", "par", "bins"],
}


# missing months: single ones, and a whole year of one glacier
_GAPS = {
    "temp": "case when not ((glacier_id = 3 and yr = 1996) or (glacier_id * 5 + yr * 3 + mo * 7) % 61 = 0) then temp end as temp",
    "prcp": "case when not ((glacier_id = 3 and yr = 1996) or (glacier_id * 3 + yr * 7 + mo * 5) % 67 = 0) then prcp end as prcp",
}


def with_views(sql: str, gaps: bool = False) -> str:
    """Put the views named in ``sql`` in front of it; ``gaps`` for views with missing months."""
    names = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    wanted = [n for n in SQL_VIEWS if n in names]
    for n in list(wanted):
        wanted += [d for d in _NEEDS.get(n, []) if d not in wanted]
    ordered = [n for n in SQL_VIEWS if n in wanted]
    text = dict(SQL_VIEWS)
    if gaps:
        text["mon"] = f"select glacier_id, yr, mo, {_GAPS['temp']}, {_GAPS['prcp']} from ({SQL_VIEWS['mon']})"
        text["ens"] = f"select glacier_id, gcm, ssp, yr, mo, {_GAPS['temp']}, {_GAPS['prcp']} from ({SQL_VIEWS['ens']})"
    ctes = [f"{n} as (\n{text[n]}\n)" for n in ordered]
    body = sql.strip()
    if body[:5].lower() == "with ":
        rest = body[5:].lstrip()
        word = "with "
        if rest.lower().startswith("recursive "):
            word, rest = "with recursive ", rest[10:]
        return word + (",\n".join(ctes) + ",\n" if ctes else "") + rest
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
