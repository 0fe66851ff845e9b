"""Statistics of overlapping groups from partial aggregates at the finest key.

Rows are combined once, by the finest key (month, regions, cell) and a bucket of
their value, to count, sum, sum of squares, least and greatest.  Region sets and
windows multiply these states, not the rows, and each time they are merged again.

A robust mean needs the median of a group and the rows near it.  The states tell
which bucket holds the median and, whatever value it has there, which buckets lie
surely within the screen, surely outside, or across its border.  Only buckets of
the median and of the border need single values.  A state of one value gives it
itself; for the others the rows are read a second time, filtered by the finest
states wanted before they are multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.functions.quantiles import order_bucket
from glacierlens.operators.altimetry import Screen
from glacierlens.session import attach, settle, shared_folder

# a level multiplies rows or states, and names the keys that states are merged by afterwards
Level = tuple[Callable[[DataFrame], DataFrame], Sequence[str]]

STATE = ["__n", "__s", "__q", "__lo", "__hi"]
# values this close to a border are compared one by one, so that rounding decides as it does for rows
MARGIN = 1e-6


def states(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, sum of squares, least and greatest of ``value`` by ``keys``."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.sum(v).alias("__s"), F.sum(v * v).alias("__q"), F.min(v).alias("__lo"), F.max(v).alias("__hi")
    )


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of ``keys`` from states of finer ones."""
    return parts.groupBy(*keys).agg(
        F.sum("__n").alias("__n"), F.sum("__s").alias("__s"), F.sum("__q").alias("__q"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")
    )


def moments() -> tuple[Column, Column]:
    """Mean and standard error of a state; one value has no spread and gives 0."""
    n = F.col("__n")
    spread = F.greatest(F.col("__q") - F.col("__s") * F.col("__s") / n, F.lit(0.0)) / (n - 1)
    sd = F.when((n > 1) & (F.col("__lo") < F.col("__hi")), F.sqrt(spread)).otherwise(F.lit(0.0))
    return F.col("__s") / n, sd / F.sqrt(n)


def _kept(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _marked(top: DataFrame, keys: list[str], second: float) -> DataFrame:
    """Buckets of each key: rank before, the ranks of the median, and where the bucket lies."""
    per_key = Window.partitionBy(*keys)
    total = F.sum("__n").over(per_key)
    rows = top.withColumns({"__before": F.sum("__n").over(per_key.orderBy("__b")) - F.col("__n"), "__total": total})
    # the two middle ranks, equal for an odd number
    rows = rows.withColumns({"__r1": F.floor((F.col("__total") + 1) / 2), "__r2": F.ceil((F.col("__total") + 1) / 2)})

    def holds(rank):
        return (F.col(rank) > F.col("__before")) & (F.col(rank) <= F.col("__before") + F.col("__n"))

    low = F.min(F.when(holds("__r1"), F.col("__lo"))).over(per_key)
    high = F.max(F.when(holds("__r2"), F.col("__hi"))).over(per_key)
    rows = rows.withColumns({"__m_lo": low, "__m_hi": high, "__median": holds("__r1") | holds("__r2")})
    inside = (F.col("__lo") > F.col("__m_hi") - second + MARGIN) & (F.col("__hi") < F.col("__m_lo") + second - MARGIN)
    outside = (F.col("__hi") < F.col("__m_lo") - second - MARGIN) | (F.col("__lo") > F.col("__m_hi") + second + MARGIN)
    return rows.withColumns({"__inside": inside, "__border": ~inside & ~outside}).drop("__m_lo", "__m_hi")


def _values(rows: DataFrame, levels: Sequence[Level], merged_: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """``keys, __b, __v, __c``: values and counts of the wanted buckets.

    ``rows`` have the finest keys, ``__b`` and ``__v``; ``wanted`` has the last level's keys, ``__b``, and its state.
    """
    keys = [*levels[-1][1], "__b"]
    one = F.col("__lo") == F.col("__hi")
    value = [*keys, F.col("__lo").alias("__v"), F.col("__n").alias("__c")]
    found = wanted.where(one).select(*value)
    mixed = settle(wanted.where(~one).select(*keys))
    if len(levels) > 1:
        (first, finer), (second, _) = levels
        parts = attach(second(merged_[0]), mixed, keys)
        found = found.unionByName(parts.where(one).select(*value))
        # the finer states with several values, each once however many windows want it
        open_ = settle(parts.where(~one).select(*finer, "__b").distinct())
        near = second(attach(first(rows), open_, [*finer, "__b"]))
    else:
        near = levels[0][0](rows)
    near = attach(near, mixed, keys).select(*keys, "__v", F.lit(1).cast("long").alias("__c"))
    return found.unionByName(near).groupBy(*keys, "__v").agg(F.sum("__c").alias("__c"))


def robust_stats(rows: DataFrame, fine: Sequence[str], levels: Sequence[Level], screen: Screen) -> DataFrame:
    """mean, n, se after the screen, by the keys of the last level; too few rows give NULL, 0, NULL.

    ``rows`` have ``dh`` and the finest keys ``fine``.  ``levels`` (one or two) multiply
    them: the first sees the finest keys, the second the first one's keys.  The
    screen's second step must keep survivors of its first.
    """
    if not screen.from_survivors:
        raise ValueError("the lattice holds survivors of the first step only")
    keys = list(levels[-1][1])
    near = rows.where(screen.base() & (F.abs("dh") < screen.first))
    near = near.select(*fine, F.col("dh").cast("double").alias("__v"), order_bucket(F.col("dh")).alias("__b"))
    parts = states(near, [*fine, "__b"], "__v")
    merged_ = []
    for multiply, level_keys in levels:
        parts = _kept(merged(multiply(parts), [*level_keys, "__b"]))
        merged_.append(parts)

    marked = _kept(_marked(parts, keys, screen.second))
    wanted = marked.where("__median or __border")
    values = _kept(_values(near, levels, merged_, wanted))
    placed = values.join(wanted.drop(*STATE), [*keys, "__b"])

    at = F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy("__v")) + F.col("__before")
    ranked = placed.where("__median").withColumn("__at", at)

    def holding(rank):
        return F.min(F.when((F.col(rank) <= F.col("__at")) & (F.col(rank) > F.col("__at") - F.col("__c")), F.col("__v")))

    pair = ranked.groupBy(*keys).agg(holding("__r1").alias("__low"), holding("__r2").alias("__high"), F.first("__total").alias("__total"))
    half = (F.col("__total") + 1) / 2
    med = settle(pair.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * (half - F.floor(half))).alias("__med")))

    across = attach(placed.where("__border"), med, keys).where(F.abs(F.col("__v") - F.col("__med")) < screen.second)
    v, c = F.col("__v"), F.col("__c")
    across = across.select(*keys, c.alias("__n"), (c * v).alias("__s"), (c * v * v).alias("__q"), v.alias("__lo"), v.alias("__hi"))
    stats = merged(marked.where("__inside").select(*keys, *STATE).unionByName(across), keys)
    mean, se = moments()
    enough = F.coalesce(F.col("__n"), F.lit(0)) >= screen.min_n
    return med.select(*keys).join(stats, keys, "left").select(
        *keys, F.when(enough, mean).alias("mean"), F.when(enough, F.col("__n")).otherwise(F.lit(0)).cast("long").alias("n"), F.when(enough, se).alias("se")
    )


def band_stats(rows: DataFrame, fine: Sequence[str], levels: Sequence[Level], value: str = "dh") -> DataFrame:
    """mean, n, se by the keys of the last level, for rows that are filtered already."""
    parts = states(rows, fine, value)
    for multiply, level_keys in levels:
        parts = merged(multiply(parts), level_keys)
    mean, se = moments()
    return parts.select(*levels[-1][1], mean.alias("mean"), F.col("__n").alias("n"), se.alias("se"))
