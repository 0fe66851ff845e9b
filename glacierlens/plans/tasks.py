"""Queries on the extension surface: tasks, named aggregates, plug-ins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from glacierlens.operators import balance as mb
from glacierlens.operators import climate as cl
from glacierlens.operators import tasks as ta
from glacierlens.plans.registry import query, rounded
from glacierlens.plans.sqltext import R


def _mean_temp(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user task that fails for some glaciers."""
    if pdf["glacier_id"].iloc[0] % 7 == 3:
        raise ValueError("no usable climate")
    return pd.DataFrame([{"mean_temp": pdf.sort_values(["yr", "mo"])["temp"].mean(), "n": len(pdf)}])


def _run(v, done=None):
    return ta.apply_per_glacier(v.mon, _mean_temp, "mean_temp double, n long", done=done)


@query("X01_apply_per_glacier", f"""select glacier_id, case when glacier_id % 7 <> 3 then {R('avg(temp)')} end as mean_temp, case when glacier_id % 7 <> 3 then count(*) end as n,
  case when glacier_id % 7 = 3 then 'ValueError' else 'SUCCESS' end as status, case when glacier_id % 7 = 3 then 'no usable climate' end as error
from mon where glacier_id >= 5 group by 1""")
def _(v):
    # the first glaciers are done already and are skipped
    done = v.table("nation").where(F.col("n_nationkey") < 5).select(F.col("n_nationkey").alias("glacier_id"))
    return rounded(_run(v, done).drop("seconds"))


@query("A57_task_summary", """with s as (select distinct glacier_id from mon)
select glacier_id, 'SUCCESS' as climate, case when glacier_id % 7 = 3 then 'ValueError' else 'SUCCESS' end as mean, 'SUCCESS' as climate_n from s""")
def _(v):
    first = v.mon.select("glacier_id").distinct().withColumn("climate", F.lit("SUCCESS"))
    log = ta.task_log(_run(v), "mean")
    again = v.mon.select("glacier_id").distinct().withColumn("status", F.lit("SUCCESS")).withColumn("seconds", F.lit(0.0)).withColumn("task", F.lit("climate"))
    return ta.task_summary(log.unionByName(again.select(*log.columns)), ["climate", "mean"], earlier=first)


_AGGS = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "count": "count", "std": "stddev_samp", "median": "median"}


@query("X03_named_aggregates", "select floor(cen_lon) as cell_lon, floor(cen_lat) as cell_lat, " + ", ".join(
    f"{R(f'{fn}(ref_hgt)')} as {name}" for name, fn in _AGGS.items()) + " from gl group by 1, 2")
def _(v):
    out = None
    for name in _AGGS:
        g = cl.grid_aggregate(v.gl, "ref_hgt", agg=name).select("cell_lon", "cell_lat", F.col("value").cast("double").alias(name))
        out = g if out is None else out.join(g, ["cell_lon", "cell_lat"])
    return rounded(out)


@query("X04_balance_model", f"""select o.glacier_id, o.yr, {R('least((b.h - (p.ref_hgt + (m.t) * 150e0)) * 3e0, 1500e0)')} as mb from (select distinct glacier_id, yr from mon) o
join (select glacier_id, yr, avg(temp) as t from mon group by 1, 2) m on o.glacier_id = m.glacier_id and o.yr = m.yr
join par p on p.glacier_id = o.glacier_id join (select glacier_id, sum(height * width) / sum(width) as h from bins group by 1) b on b.glacier_id = o.glacier_id""")
def _(v):
    def by_mean_temperature(climate, params, bins, grad):
        h = bins.groupBy("glacier_id").agg((F.sum(F.col("height") * F.col("width")) / F.sum("width")).alias("height"))
        warm = climate.groupBy("glacier_id", "yr").agg(F.avg("temp").alias("t"))
        ela = warm.join(params, "glacier_id").select("glacier_id", "yr", (F.col("ref_hgt") + F.col("t") * 150.0).alias("ela"))
        return mb.linear_balance(h, ela, grad, 1500.0)

    return rounded(ta.run_balance_model(by_mean_temperature, v.mon, v.par, v.bins, grad=3.0))


@query("X05_explode_offsets", """select glacier_id, cast(o as int) as offset, cast(region22 + o as int) as neighbour
from gl, (select unnest(generate_series(-1, 1)) as o)""")
def _(v):
    rows = v.gl.withColumn("offset", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    return rows.select("glacier_id", "offset", (F.col("region22") + F.col("offset")).cast("int").alias("neighbour"))
