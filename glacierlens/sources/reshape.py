"""Wide sheets to long tables and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_long(df: DataFrame, ids: str | Sequence[str], cols: Sequence[str] | None = None,
                 name: str = "period", value: str = "value") -> DataFrame:
    """One row per id and column of a sheet; missing cells are dropped."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, cols, name, value).dropna(subset=[value])


def long_to_wide(df: DataFrame, ids: str | Sequence[str], period: str, value: str,
                 periods: Sequence) -> DataFrame:
    """One column per period.  The period list is fixed, so no extra pass finds it."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.groupBy(*ids).pivot(period, list(periods)).agg(F.first(value, ignorenulls=True))


def drop_empty_rows(df: DataFrame, ids: str | Sequence[str]) -> DataFrame:
    """Drop rows of a sheet whose every period is missing."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.dropna(how="all", subset=[c for c in df.columns if c not in ids])
