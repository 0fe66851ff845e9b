"""Registry of queries: name -> Spark callable and DuckDB oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.plans import fixtures

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
# what was registered, for variants
_PLAIN: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(v)`` under ``name``; ``v`` gives the fixture views."""

    def register(fn):
        if name in _QUERIES:
            raise KeyError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixtures.Views(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        _PLAIN[name] = fn, oracle
        if oracle is not None:
            _ORACLES[name] = fixtures.with_views(oracle)
        return fn

    return register


def with_gaps(name: str) -> None:
    """Register a variant of a query (g after its id) over climate fixtures with missing months."""
    fn, oracle = _PLAIN[name]
    variant = re.sub(r"^([A-Z][0-9]{2}[a-z]?)_", r"\1g_", name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fixtures.Views(spark, sf_dir, gaps=True))

    run.__name__, run.__doc__ = variant, fn.__doc__
    _QUERIES[variant] = run
    _ORACLES[variant] = fixtures.with_views(oracle, gaps=True)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round float columns in the query output only.

    The small offset breaks exact decimal ties, which the two engines round
    differently; adding 0 removes -0.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double") + float(f"1.3e-{digits + 2}"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def queries() -> dict[str, Callable]:
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(_ORACLES.items()))


