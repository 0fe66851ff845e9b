"""Per-glacier tasks with an error log, task summaries, balance-model plug-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_per_glacier(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "glacier_id",
                      done: DataFrame | None = None, stop_on_error: bool = False) -> DataFrame:
    """Run ``fn`` on each glacier's rows; a failing glacier gives one row with its error.

    ``schema`` names the columns fn returns besides the key.  Glaciers listed
    in ``done`` are skipped.  The result adds status, error and seconds.
    """
    if done is not None:
        df = df.join(done, key, "left_anti")
    names = [part.strip().split()[0] for part in schema.split(",")]
    key_type = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = time.time()
        gid = pdf[key].iloc[0]
        try:
            out = fn(pdf)[names].copy()
            out["status"], out["error"] = "SUCCESS", None
        except Exception as e:
            if stop_on_error:
                raise
            out = pd.DataFrame([{**dict.fromkeys(names), "status": type(e).__name__, "error": str(e)}])
        out.insert(0, key, gid)
        out["seconds"] = time.time() - start
        return out[[key, *names, "status", "error", "seconds"]]

    return df.groupBy(key).applyInPandas(run, f"{key} {key_type}, {schema}, status string, error string, seconds double")


def task_log(result: DataFrame, task: str, key: str = "glacier_id") -> DataFrame:
    """One log row per glacier: task, status, seconds."""
    return result.groupBy(key).agg(F.first("status").alias("status"), F.max("seconds").alias("seconds")).withColumn("task", F.lit(task))


def task_summary(log: DataFrame, tasks: Sequence[str], earlier: DataFrame | None = None, key: str = "glacier_id",
                 value: str = "status") -> DataFrame:
    """One column per task; joined onto an earlier summary, repeated names get ``_n``."""
    wide = log.groupBy(key).pivot("task", list(tasks)).agg(F.first(value))
    if earlier is None:
        return wide
    for t in tasks:
        if t in earlier.columns:
            wide = wide.withColumnRenamed(t, f"{t}_n")
    return earlier.join(wide, key, "left")


MODEL_COLUMNS = ("glacier_id", "yr", "mb")


def run_balance_model(model: Callable[..., DataFrame], *tables: DataFrame, **options) -> DataFrame:
    """Any function of DataFrames that returns glacier_id, yr, mb is a balance model."""
    out = model(*tables, **options)
    missing = [c for c in MODEL_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"the balance model lacks {missing}")
    return out.select(*MODEL_COLUMNS)
