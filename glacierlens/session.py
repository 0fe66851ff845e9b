"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side is allowed up to this many (narrow) rows; beyond it the
# same join runs as a salted shuffle join (see attach).
BROADCAST_ROWS = 500_000
# tasks that share a key's rows in a join with a table beyond that
SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without the setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several passes read, written once as Parquet below the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a small derived table once and mark it for broadcast if it fits.

    The checkpoint cuts the lineage (the table feeds a second pass over the
    rows it was derived from) and its row count is the size check.
    """
    return settle_with_peak(df, None, max_rows)[0]


def settle_with_peak(df: DataFrame, column: str | None, max_rows: int = BROADCAST_ROWS):
    """:func:`settle`, and the largest value of a column (0 if empty)."""
    shared_folder(df.sparkSession)
    done = df.checkpoint()
    peak = F.max(column) if column else F.lit(0)
    n, top = done.agg(F.count("*"), peak).first()
    table = F.broadcast(done) if n <= max_rows else done
    table.fits_broadcast = n <= max_rows
    return table, top or 0


def attach(rows: DataFrame, table: DataFrame, keys) -> DataFrame:
    """Join a settled table to the rows it was derived from.

    A table that fits is broadcast.  Otherwise the table comes once per salt and
    a row's salt is a hash of all its columns, so a key's rows are dealt over
    ``SALTS`` tasks.  As the join is not partitioned by the keys alone, a later
    ``groupBy`` combines within each task before it shuffles.
    """
    if getattr(table, "fits_broadcast", False):
        return rows.join(table, list(keys)) if keys else rows.join(table)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a cheap dimension table, only after counting it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
