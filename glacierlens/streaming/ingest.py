"""Incremental jobs: granules into cells, daily climate into a store.

The stream is one of file names, so that a batch knows its files, reads them as a
table, and can log those that were broken or saved nothing.  What a micro-batch
writes counts from its commit record on, so a batch that runs twice after a lost
executor leaves its rows once.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.operators.climate import daily_to_monthly
from glacierlens.operators.spatial import outside_all, placed_index
from glacierlens.session import settle, shared_folder
from glacierlens.sources import commits
from glacierlens.sources.sinks import append_once, read_committed


def keep_granules(batch: DataFrame, min_rows: int = 100, file: str = "file") -> DataFrame:
    """Rows of granules (files) with more than ``min_rows`` rows."""
    sizes = batch.groupBy(file).agg(F.count("*").alias("_n")).where(F.col("_n") > min_rows).select(file)
    return batch.join(settle(sizes), file, "left_semi")


# files of any age count: a back-filled file may be older than those read before
ANY_AGE = "100000d"


def new_files(spark: SparkSession, source: str, max_files: int) -> DataFrame:
    """Stream of the paths of new Parquet files; their content is not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (
        spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).option("maxFileAge", ANY_AGE)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(source).select("path")
    )


def read_files(paths: list[str], schema: T.StructType, spark: SparkSession) -> DataFrame:
    """Rows of the files with their ``file``; a broken file gives none."""
    return (
        spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
        .parquet(*paths).withColumn("file", F.col("_metadata.file_path"))
    )


def file_log(spark: SparkSession, paths: list[str], counts: DataFrame) -> DataFrame:
    """A row for each file of a batch: ``counts`` by ``file``, 0 rows for a broken or empty one."""
    listed = spark.createDataFrame([(p,) for p in paths], "file string")
    n = [c for c in counts.columns if c != "file"]
    return listed.join(counts, "file", "left").fillna(0, n)


def _name(checkpoint: str) -> str:
    """Of a stream: batch numbers count from its checkpoint on."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _start(stream: DataFrame, save, checkpoint: str, trigger: dict | None):
    """Hand the paths of each micro-batch, as many as it may hold, to ``save``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r.path for r in batch.collect())
        if paths:
            save(paths, batch_id)

    return (
        stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_footprints(spark: SparkSession, source: str, schema: T.StructType, polygons: DataFrame, out: str,
                      checkpoint: str, min_rows: int = 100, trigger: dict | None = None, max_files: int = 1000,
                      log: str | None = None):
    """New granules: drop small ones and glacier points, append the rest by 1-degree cell.

    With ``log``, every granule leaves its rows read and saved there, also one
    that saves nothing, and every granule and cell its rows saved.  The polygon
    index is built once for all batches.
    """
    index = placed_index(polygons)
    name = _name(checkpoint)

    def save(paths: list[str], batch_id: int) -> None:
        rows = read_files(paths, schema, spark).persist()
        off_ice = outside_all(keep_granules(rows, min_rows), polygons, index=index)
        append_once(off_ice.drop("file"), out, f"{name}-{batch_id}")
        if log:
            cells = off_ice.groupBy("file", F.floor("lat").cast("int").alias("lat_cell"), F.floor("lon").cast("int").alias("lon_cell"))
            cells = cells.agg(F.count("*").alias("n_saved")).persist()
            cells.write.mode("overwrite").parquet(f"{log}/cells/batch={batch_id}")
            read = rows.groupBy("file").agg(F.count("*").alias("n_read"))
            saved = cells.groupBy("file").agg(F.sum("n_saved").alias("n_saved"))
            counts = read.join(saved, "file", "left")
            file_log(spark, paths, counts).write.mode("overwrite").parquet(f"{log}/granules/batch={batch_id}")
            cells.unpersist()
        rows.unpersist()

    return _start(new_files(spark, source, max_files), save, checkpoint, trigger)


def read_off_ice(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows saved so far with their cell; none if every granule was small."""
    return read_committed(spark, out, schema)


DAILY = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("glacier_id", T.LongType()),
    T.StructField("variable", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def stream_daily_climate(spark: SparkSession, source: str, out: str, checkpoint: str, schema: T.StructType = DAILY,
                         trigger: dict | None = None, max_files: int = 1000, log: str | None = None):
    """Sums and counts of each micro-batch per glacier, variable and day.

    Sums add up over batches, so files may come in any order and a day may be
    filled in years later: no state and no watermark.  A broken file is skipped;
    with ``log``, every file leaves its number of rows there, 0 for a broken one.
    The store holds each month once: a batch reads the months it touches, adds its
    sums, and writes these months again with their means (see :class:`Store`).
    """
    store = Store(spark, out)
    name = _name(checkpoint)

    def save(paths: list[str], batch_id: int) -> None:
        rows = read_files(paths, schema, spark)
        if log:
            rows = rows.persist()
        daily = rows.groupBy("glacier_id", "variable", F.to_date("ts").alias("obs_date")).agg(
            F.sum("value").alias("total"), F.count("value").alias("n")
        )
        store.add(daily, name, batch_id)
        if log:
            counts = rows.groupBy("file").agg(F.count("*").alias("n_read"))
            file_log(spark, paths, counts).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
            rows.unpersist()

    return _start(new_files(spark, source, max_files), save, checkpoint, trigger)


class Store:
    """Daily sums and monthly means, a folder for each month, behind a state record.

    ``daily/<generation>/month=...`` and ``monthly/<generation>/month=...``; the last
    record in ``state`` names the generation of each month and the last batch of
    each stream.  A batch that is in the state is not added again.  What neither
    the new state nor the one before it names is deleted, so the store has each month
    about once, and a reader that holds the last state still finds its files.
    """

    DAYS = "glacier_id long, variable string, obs_date date, total double, n long"
    MONTHS = "glacier_id long, variable string, first_day date, value double, n_days long"

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")

    def state(self) -> tuple[int, dict]:
        found = commits.latest(self.spark, f"{self.out}/state")
        return (int(found[0]), found[1]) if found else (0, {"months": {}, "batches": {}, "before": {}})

    def _read(self, kind: str, schema: str, months: dict[str, str]) -> DataFrame:
        paths = [f"{self.out}/{kind}/{gen}/month={m}" for m, gen in sorted(months.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def daily(self) -> DataFrame:
        return self._read("daily", self.DAYS, self.state()[1]["months"])

    def monthly(self) -> DataFrame:
        return self._read("monthly", self.MONTHS, self.state()[1]["months"]).withColumnRenamed("first_day", "month")

    def add(self, daily: DataFrame, stream: str, batch: int) -> bool:
        """Add a batch's daily sums; False where the stream's batch is in the store."""
        number, state = self.state()
        if state["batches"].get(stream, -1) >= batch:
            return False
        shared_folder(self.spark)
        fresh = daily.withColumn("month", F.coalesce(F.date_format("obs_date", "yyyy-MM"), F.lit("none"))).checkpoint()
        # as many as the calendar has
        touched = [r.month for r in fresh.select("month").distinct().collect()]
        kept = self._read("daily", self.DAYS, {m: g for m, g in state["months"].items() if m in touched})
        both = fresh.drop("month").unionByName(kept).groupBy("glacier_id", "variable", "obs_date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        both = both.withColumn("month", F.coalesce(F.date_format("obs_date", "yyyy-MM"), F.lit("none")))
        generation = f"{number + 1:010d}-{uuid.uuid4().hex}"
        both.hint("rebalance", F.col("month")).write.partitionBy("month").parquet(f"{self.out}/daily/{generation}")
        days = self._read("daily", self.DAYS, dict.fromkeys(touched, generation))
        means = daily_to_monthly(days.withColumn("value", F.when(F.col("n") > 0, F.col("total") / F.col("n"))))
        means = means.withColumnRenamed("month", "first_day").withColumn("month", F.coalesce(F.date_format("first_day", "yyyy-MM"), F.lit("none")))
        means.hint("rebalance", F.col("month")).write.partitionBy("month").parquet(f"{self.out}/monthly/{generation}")
        months = state["months"] | dict.fromkeys(touched, generation)
        new = {"months": months, "batches": state["batches"] | {stream: batch}, "before": state["months"]}
        commits.record(self.spark, f"{self.out}/state", f"{number + 1:010d}", new)
        for month, gen in state["before"].items():
            if gen not in (state["months"].get(month), months.get(month)):
                for kind in ("daily", "monthly"):
                    commits.remove(self.spark, f"{self.out}/{kind}/{gen}/month={month}")
        return True


def read_daily_store(spark: SparkSession, out: str) -> DataFrame:
    """Each day of the store, added over the batches."""
    return Store(spark, out).daily()


def monthly_from_store(spark: SparkSession, out: str) -> DataFrame:
    """Monthly means of the daily means, as the batch job gives them; they are read, not computed."""
    return Store(spark, out).monthly()
