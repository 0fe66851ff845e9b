"""Scans: typed footprints, dated files, several folders, batches, series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.functions.scalars import nan_to_null

_D, _I = T.DoubleType(), T.IntegerType()

# footprint columns as read from files; a mission may lack some of them
FOOTPRINT = T.StructType(
    [
        T.StructField("track", T.StringType()),
        T.StructField("lon", _D),
        T.StructField("lat", _D),
        T.StructField("seconds", _D),
        T.StructField("h_obs", _D),
        T.StructField("geoid", _D),
        T.StructField("quality", _D),
    ]
)

# fixed values: reference date and the rule that turns seconds into days
MISSIONS = {
    "photon": ("2018-01-01", "floor"),
    "laser": ("2000-01-01", "round"),
    "radar": ("1970-01-01", "floor"),
}


def read_footprints(spark: SparkSession, path, mission: str, fmt: str = "parquet", schema: T.StructType = FOOTPRINT) -> DataFrame:
    """Typed footprint rows; NaN becomes NULL, seconds become whole days."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return typed_footprints(reader.load(path), mission)


def typed_footprints(raw: DataFrame, mission: str) -> DataFrame:
    ref, how = MISSIONS[mission]
    days = F.col("seconds") / 86400.0
    day = (F.floor(days) if how == "floor" else F.round(days)).cast("int")
    floats = [f.name for f in raw.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = [nan_to_null(c).alias(c) if c in floats else F.col(c) for c in raw.columns]
    out = raw.select(*cols).withColumn("obs_day", day)
    return (
        out.withColumn("obs_date", F.date_add(F.lit(ref).cast("date"), F.col("obs_day")))
        .withColumn("quality", F.col("quality").cast("int"))
        .drop("seconds")
    )


def scan_dated(
    spark: SparkSession, path: str, pattern: str, date_format: str, fmt: str = "parquet",
    schema: T.StructType | None = None, glob: str | None = None,
) -> DataFrame:
    """Rows with the date found in the file path; a path without one is an error."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    name = F.col("_metadata.file_path")
    text = F.regexp_extract(name, pattern, 1)
    parsed = F.try_to_timestamp(text, F.lit(date_format)).cast("date")
    checked = F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("no date in file name "), name)).cast("date")
    )
    return df.select("*", checked.alias("file_date"))


def scan_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """One logical table from several folders."""
    return spark.read.format(fmt).load(list(paths))


def merge_batches(spark: SparkSession, folder: str, order: str, fmt: str = "parquet") -> DataFrame:
    """All batch outputs below a folder but the ones called "all", ordered by id.

    A batch's name is the first folder below ``folder``, however deep its files lie.
    """
    df = spark.read.format(fmt).option("recursiveFileLookup", True).load(folder)
    top = folder.rstrip("/").rsplit("/", 1)[-1]
    below = F.substring_index(F.col("_metadata.file_path"), f"/{top}/", -1)
    batch = F.split(below, "/")[0]
    return df.where(~F.contains(batch, F.lit("all"))).orderBy(order)


def select_series(
    df: DataFrame, variable: str | None = None, glacier: Column | None = None,
    t0: str | None = None, t1: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Label-based slice of the daily cube (both ends inclusive), mean over the other dimensions."""
    if variable is not None:
        df = df.where(F.col("variable") == variable)
    if glacier is not None:
        df = df.where(glacier)
    if t0 is not None:
        df = df.where(F.col("obs_date") >= F.lit(t0).cast("date"))
    if t1 is not None:
        df = df.where(F.col("obs_date") <= F.lit(t1).cast("date"))
    return df.groupBy(*by).agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def flatten_grid(
    df: DataFrame, box: tuple[float, float, float, float], t0: str, t1: str, values: Sequence[str], time: str = "time",
    drop: Sequence[str] = ("expver",),
) -> DataFrame:
    """Crop a gridded table to a lon/lat box and dates, keep points with finite values."""
    lon0, lat0, lon1, lat1 = box
    out = df.where(
        F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1)
        & F.col(time).between(F.lit(t0).cast("date"), F.lit(t1).cast("date"))
    ).drop(*drop)
    for c in values:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out
