"""Reading tables and cutting lineage through written tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glacierlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a stage's result below the shared folder and read it back.

    The lineage ends there, so a lost executor costs one stage at most.
    Dropping the references lets Spark's cleaner free the finished shuffle
    files, so that the disk holds one stage at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path, **options)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables.  Only once all that was made from them is written too."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blocks(df: DataFrame, size: F.Column, per_block: float, least: int = 1) -> int:
    """Number of blocks with about ``per_block`` of the summed ``size`` each."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return max(least, int(total / per_block) + 1)
