"""Scans, sinks and streams on small files."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glacierlens.operators import climate as cl
from glacierlens.operators import tasks as ta
from glacierlens.sources import reshape, scans, sinks
from glacierlens.streaming import ingest


def test_days_round_or_floor_and_nan(spark):
    rows = [("t", 70.0, 30.0, 86400 * 2 + 50000.0, float("nan"), 1.0, 0.0)]
    raw = spark.createDataFrame(rows, scans.FOOTPRINT)
    laser, photon = (scans.typed_footprints(raw, m).first() for m in ("laser", "photon"))
    assert (laser["obs_day"], photon["obs_day"], laser["h_obs"]) == (3, 2, None)
    assert str(laser["obs_date"]) == "2000-01-04" and str(photon["obs_date"]) == "2018-01-03"


def test_csv_footprints(spark, tmp_path):
    raw = spark.createDataFrame([("t", 70.0, 30.0, 86400.0, 5.0, 1.0, 1.0)], scans.FOOTPRINT)
    raw.write.option("header", True).csv(str(tmp_path / "c"))
    assert scans.read_footprints(spark, str(tmp_path / "c"), "photon", fmt="csv").first()["obs_day"] == 1


def test_bad_file_name_is_an_error(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "x_20200101"))
    ok = scans.scan_dated(spark, str(tmp_path), r"_(\d{8})/", "yyyyMMdd")
    assert {str(r["file_date"]) for r in ok.collect()} == {"2020-01-01"}
    spark.range(2).write.parquet(str(tmp_path / "oops"))
    with pytest.raises(Exception, match="no date in file name"):
        scans.scan_dated(spark, str(tmp_path), r"_(\d{8})/", "yyyyMMdd").collect()


def test_wide_and_long(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0)], "id int, p string, x double")
    wide = reshape.long_to_wide(long, "id", "p", "x", ["a", "b", "c"])
    assert wide.columns == ["id", "a", "b", "c"]
    back = reshape.wide_to_long(wide, "id", name="p", value="x")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    assert reshape.drop_empty_rows(wide.select("id", "a"), "id").count() == 1


def test_append_adds_to_the_same_cell(spark, tmp_path):
    df = spark.createDataFrame([(70.2, 30.5), (70.9, 30.1), (-0.5, -0.5)], "lon double, lat double")
    for _ in range(2):
        sinks.append_by_cell(df, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).groupBy("lat_cell", "lon_cell").count().collect()
    assert sorted(map(tuple, got)) == [(-1, -1, 2), (30, 70, 4)]
    assert sinks.saved_rows(df).agg(F.sum("n_saved")).first()[0] == 3


def _poly(spark):
    ring = [(70, 30), (71, 30), (71, 31), (70, 31), (70, 30)]
    return spark.createDataFrame([("g", 1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)],
                                 "hier string, id long, ring int, vertex int, x double, y double")


def test_stream_of_granules(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))

    def granule(name, n):
        pdf = pd.DataFrame({"lon": [70.5, 72.5] * (n // 2), "lat": 30.5, "dh": 1.0})
        spark.createDataFrame(pdf).coalesce(1).write.parquet(f"{src}/{name}")

    granule("small", 100)
    schema = spark.read.parquet(f"{src}/small").schema
    ingest.stream_footprints(spark, src, schema, _poly(spark), out, chk).awaitTermination()
    assert ingest.read_off_ice(spark, out, schema).count() == 0
    granule("big", 200)
    for _ in range(2):
        ingest.stream_footprints(spark, src, schema, _poly(spark), out, chk).awaitTermination()
    granule("late", 300)
    ingest.stream_footprints(spark, src, schema, _poly(spark), out, chk).awaitTermination()
    got = ingest.read_off_ice(spark, out, schema).groupBy("lat_cell", "lon_cell").count().collect()
    assert [tuple(r) for r in got] == [(30, 72, 100 + 150)]


def test_stream_of_days_equals_the_batch(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    rows = []
    for day in range(40):
        ts = dt.datetime(2020, 1, 10) + dt.timedelta(days=day)
        part = [(ts + dt.timedelta(hours=h), g, "t", None if (day + g) % 5 == 0 else float(day * g + h)) for g in (1, 2) for h in (1, 13)]
        rows += part
        spark.createDataFrame(part, ingest.DAILY).coalesce(1).write.parquet(f"{src}/d{day:02d}")
        if day in (15, 39):
            # several micro-batches, days in order
            ingest.stream_daily_climate(spark, src, out, chk, max_files=7).awaitTermination()
    daily = spark.createDataFrame(rows, ingest.DAILY).groupBy("glacier_id", "variable", F.to_date("ts").alias("obs_date")).agg(F.avg("value").alias("value"))
    want = cl.daily_to_monthly(daily)
    got = ingest.monthly_from_store(spark, out)
    key = lambda d: sorted((r["glacier_id"], str(r["month"]), round(r["value"], 9), r["n_days"]) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) == 4


def test_days_in_any_order_and_a_broken_file(spark, tmp_path):
    src, out, chk, log = (str(tmp_path / n) for n in ("src", "out", "chk", "log"))
    days = [dt.datetime(2020, 2, 10), dt.datetime(2020, 3, 1), dt.datetime(2020, 1, 5), dt.datetime(2020, 2, 10, 12)]
    rows = [(ts, 1, "t", float(i)) for i, ts in enumerate(days)]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], ingest.DAILY).coalesce(1).write.parquet(f"{src}/f{i}")
        if i == 1:
            (tmp_path / "src" / "broken.parquet").write_bytes(b"no parquet at all")
        ingest.stream_daily_climate(spark, src, out, chk, log=log).awaitTermination()
    got = {str(r["obs_date"]): (r["total"], r["n"]) for r in ingest.read_daily_store(spark, out).collect()}
    assert got == {"2020-02-10": (3.0, 2), "2020-03-01": (1.0, 1), "2020-01-05": (2.0, 1)}
    logged = spark.read.parquet(log).collect()
    assert len(logged) == 5
    assert [r["file"].rsplit("/", 1)[-1] for r in logged if r["n_read"] == 0] == ["broken.parquet"]


def test_granule_log(spark, tmp_path):
    src, out, chk, log = (str(tmp_path / n) for n in ("src", "out", "chk", "log"))
    for name, n in (("small", 100), ("big", 200)):
        spark.createDataFrame(pd.DataFrame({"lon": [70.5, 72.5] * (n // 2), "lat": 30.5, "dh": 1.0})).coalesce(1).write.parquet(f"{src}/{name}")
    schema = spark.read.parquet(f"{src}/small").schema
    ingest.stream_footprints(spark, src, schema, _poly(spark), out, chk, log=log).awaitTermination()
    got = sorted((r["n_read"], r["n_saved"]) for r in spark.read.parquet(f"{log}/granules").collect())
    assert got == [(100, 0), (200, 100)]
    assert [(r["lat_cell"], r["lon_cell"], r["n_saved"]) for r in spark.read.parquet(f"{log}/cells").collect()] == [(30, 72, 100)]


def test_append_dies_half_way_and_runs_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cells")
    df = spark.createDataFrame([(70.5, 30.5, 1), (70.5, 30.2, 2), (71.5, 30.5, 3)], "lon double, lat double, v int")
    assert sinks.read_committed(spark, path, df.schema).count() == 0
    assert sinks.append_once(df, path, "a")
    monkeypatch.setattr(sinks.commits, "record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.append_once(df, path, "b")
    assert sinks.read_committed(spark, path, df.schema).count() == 3
    monkeypatch.undo()
    assert sinks.append_once(df, path, "b") and not sinks.append_once(df, path, "b") and not sinks.append_once(df, path, "a")
    back = sinks.read_committed(spark, path, df.schema)
    assert back.count() == 6 and {(r.lat_cell, r.lon_cell) for r in back.collect()} == {(30, 70), (30, 71)}
    assert sinks.drop_orphans(spark, path) == 1 and sinks.drop_orphans(spark, path) == 0
    assert sinks.read_committed(spark, path, df.schema).count() == 6


def test_store_holds_each_month_once(spark, tmp_path):
    """Batches in any order and twice; the files left are about those of the months."""
    store = ingest.Store(spark, str(tmp_path / "store"))
    rng = np.random.default_rng(4)
    rows = [(int(g), "t", dt.date(2020, 1, 1) + dt.timedelta(days=int(d)), float(v), 1) for g, d, v in zip(rng.integers(1, 4, 120), rng.integers(0, 90, 120), rng.integers(0, 50, 120))]
    rows[7] = (1, "t", None, 5.0, 1)
    rows[8] = (2, "t", dt.date(2020, 1, 3), None, 0)
    for batch in range(12):
        part = spark.createDataFrame(rows[batch * 10 : batch * 10 + 10], ingest.Store.DAYS)
        assert store.add(part, "s", batch)
        assert not store.add(part, "s", batch)
    every = spark.createDataFrame(rows, ingest.Store.DAYS).groupBy("glacier_id", "variable", "obs_date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    assert sorted(map(str, store.daily().collect())) == sorted(map(str, every.collect()))
    want = cl.daily_to_monthly(every.withColumn("value", F.when(F.col("n") > 0, F.col("total") / F.col("n"))))
    key = lambda d: sorted((r["glacier_id"], str(r["month"]), round(r["value"], 9), r["n_days"]) for r in d.collect())
    assert key(store.monthly()) == key(want)
    folders = [p for p in (tmp_path / "store" / "daily").glob("*/month=*")]
    assert len({p.name for p in folders}) == 4 and len(folders) <= 8
    assert store.add(spark.createDataFrame(rows[:3], ingest.Store.DAYS), "another stream", 0)


def test_merge_leaves_out_a_partitioned_total(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (2, 3)], "id int, ssp int")
    df.write.parquet(str(tmp_path / "runs" / "run_batch_0"))
    df.write.partitionBy("ssp").parquet(str(tmp_path / "runs" / "run_all"))
    assert scans.merge_batches(spark, str(tmp_path / "runs"), "id").count() == 2


def test_tasks_go_on_after_an_error(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "glacier_id long, x double")

    def fn(pdf):
        if pdf.glacier_id.iloc[0] == 2:
            raise KeyError("gone")
        return pd.DataFrame({"y": pdf.x * 2})

    got = {r["glacier_id"]: r for r in ta.apply_per_glacier(df, fn, "y double").collect()}
    assert got[1]["y"] == 4.0 and got[1]["status"] == "SUCCESS" and got[1]["seconds"] >= 0
    assert got[2]["y"] is None and got[2]["status"] == "KeyError"
    with pytest.raises(Exception, match="gone"):
        ta.apply_per_glacier(df, fn, "y double", stop_on_error=True).collect()


def test_model_plugin_is_checked(spark):
    with pytest.raises(ValueError, match="lacks"):
        ta.run_balance_model(lambda d: d, spark.range(1))
