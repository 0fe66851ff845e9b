"""Sinks: results by measure, by region, by cell."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.sources import commits


def write_results(df: DataFrame, path: str, keys: Sequence[str], measures: Sequence[str] = ("mean", "n", "se"),
                  mode: str = "overwrite") -> None:
    """value / count / uncertainty as one long table, one folder per measure."""
    casted = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    long = casted.unpivot(list(keys), list(measures), "measure", "value")
    # AQE splits a large measure over writers and merges small ones
    long.hint("rebalance", F.col("measure")).write.mode(mode).partitionBy("measure").parquet(path)


def write_by_region(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Band x year output, one unit per region; a large region gets several writers."""
    df.hint("rebalance", F.col("hier"), F.col("region_id")).write.mode(mode).partitionBy("hier", "region_id").parquet(path)


def append_by_cell(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat", mode: str = "append") -> None:
    """Rows into the folder of their 1-degree cell.

    The rebalance brings a cell's rows together, so there is no file per task
    and cell, while AQE splits a hot cell over many writers.
    """
    cells = df.withColumn("lat_cell", F.floor(lat).cast("int")).withColumn("lon_cell", F.floor(lon).cast("int"))
    cells = cells.hint("rebalance", F.col("lat_cell"), F.col("lon_cell"))
    cells.write.mode(mode).partitionBy("lat_cell", "lon_cell").parquet(path)


def append_once(df: DataFrame, path: str, append_id: str, lon: str = "lon", lat: str = "lat") -> bool:
    """Append rows by cell under an id; False, and nothing is written, where that id was appended before.

    The rows go into a folder of this attempt.  The commit record comes last, so
    an append that died half way left nothing that readers see and may be repeated.
    """
    spark = df.sparkSession
    if commits.find(spark, f"{path}/commits", append_id):
        return False
    folder = f"{append_id}-{uuid.uuid4().hex}"
    append_by_cell(df, f"{path}/data/append={folder}", lon, lat, mode="overwrite")
    commits.record(spark, f"{path}/commits", append_id, {"folder": folder})
    return True


CELLS = [T.StructField(c, T.IntegerType()) for c in ("lat_cell", "lon_cell")]


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all committed appends with their cell; one folder for each append is listed."""
    every = T.StructType([*schema.fields, *[c for c in CELLS if c.name not in schema.names]])
    folders = sorted(json.loads(r.content)["folder"] for r in commits.records(spark, f"{path}/commits").collect())
    if not folders:
        return spark.createDataFrame([], every)
    table = spark.read.schema(T.StructType([*every.fields, T.StructField("append", T.StringType())])).option("basePath", f"{path}/data")
    return table.parquet(*[f"{path}/data/append={f}" for f in folders]).drop("append")


def drop_orphans(spark: SparkSession, path: str) -> int:
    """Delete folders of appends that were never committed; only while none is running."""
    known = {"append=" + json.loads(r.content)["folder"] for r in commits.records(spark, f"{path}/commits").collect()}
    lost = [f for f in commits.children(spark, f"{path}/data") if f not in known]
    for folder in lost:
        commits.remove(spark, f"{path}/data/{folder}")
    return len(lost)


def saved_rows(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Row count per cell, the log of an append."""
    return df.groupBy(F.floor(lat).cast("int").alias("lat_cell"), F.floor(lon).cast("int").alias("lon_cell")).agg(
        F.count("*").alias("n_saved")
    )
