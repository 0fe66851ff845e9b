"""Records that make written folders count: a folder without a record is not read.

A record is a small JSON table in a folder of its own, so it is there as a whole or not
at all.  A job that dies before its record leaves only folders that no reader sees,
and may run again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    at, fs = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def record(spark: SparkSession, path: str, name: str, content: dict) -> None:
    """Commit ``content`` under ``name``; a record of that name is replaced."""
    rows = spark.createDataFrame([(name, json.dumps(content))], "name string, content string")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of all records below ``path``."""
    schema = "name string, content string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def find(spark: SparkSession, path: str, name: str) -> dict | None:
    row = records(spark, f"{path}/{name}").first()
    return row and json.loads(row.content)


def latest(spark: SparkSession, path: str) -> tuple[str, dict] | None:
    """Name and content of the record with the greatest name."""
    row = records(spark, path).orderBy(F.desc("name")).first()
    return row and (row.name, json.loads(row.content))
