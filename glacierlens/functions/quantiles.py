"""Exact grouped order statistics that never gather a group in one task.

Pass 1 counts rows per (key, value bucket), where the bucket is an
order-preserving function of the value alone, so the counts combine map-side.
Prefix sums over the buckets of a key tell which buckets hold the wanted
ranks.  While such a bucket holds more than ``CANDIDATES`` rows and more than one
value, another pass splits it evenly between its least and greatest value, which
come from the same counts; so any scale of values takes as many passes.  The last
pass keeps only the rows of the final buckets, counts them per distinct value, and
finds the rank inside the bucket.  No pass shuffles whole rows of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glacierlens.session import attach, settle, settle_with_peak

# buckets per doubling of the value in the first pass; parts of a bucket in each further one
PER_OCTAVE = 8
REFINE = 256
# rows of one bucket that one task may sort at the end
CANDIDATES = 2_000_000


def order_bucket(value: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Coarse integer that never decreases when ``value`` increases."""
    octaves = F.log2(F.lit(1.0) + F.abs(value))
    return (F.signum(value) * F.floor(octaves * per_octave)).cast("long")


def rank_position(n: Column, p: float | Column, kind: str) -> Column:
    """1-based fractional rank of percentile ``p`` (0..1) among n sorted values.

    ``linear`` is (n-1)p+1; ``midpoint`` puts sample i at (i-0.5)/n and clamps.
    """
    p = p if isinstance(p, Column) else F.lit(float(p))
    if kind == "linear":
        return (n - 1) * p + 1
    if kind == "midpoint":
        return F.least(F.greatest(n * p + 0.5, F.lit(1.0)), n.cast("double"))
    raise ValueError(f"unknown percentile kind {kind!r}")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float | Column],
    kind: str = "linear",
) -> DataFrame:
    """One row per key: ``n`` and one exact percentile column per entry of ``probs``.

    A percentile may be a column, if it is made of ``keys`` only.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))

    # the buckets of one key are few, so a window per key over them is small
    per_key = Window.partitionBy(*keys)
    tally = [F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    counts = rows.groupBy(*keys, order_bucket(F.col("__v")).alias("__b")).agg(*tally)
    counts = counts.withColumn(
        "__before", F.sum("__c").over(per_key.orderBy("__b")) - F.col("__c")
    ).withColumn("__n", F.sum("__c").over(per_key))

    ranks = []
    for p in probs.values():
        pos = rank_position(F.col("__n"), p, kind)
        ranks += [F.floor(pos).cast("long"), F.ceil(pos).cast("long")]

    # a bucket of one value has nothing to split, however many rows it holds
    spread = F.when(F.col("__hi") > F.col("__lo"), F.col("__c")).otherwise(0).alias("__open")

    def holding(table, wanted):
        inside = F.filter(wanted, lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("__c")))
        hit = table.select(*keys, "__b", "__lo", "__hi", "__before", "__n", spread, inside.alias("__want"))
        return settle_with_peak(hit.where(F.size("__want") > 0), "__open")

    targets, fullest = holding(counts, F.array_distinct(F.array(*ranks)))
    placed = rows.withColumn("__b", order_bucket(F.col("__v")))

    def within(targets):
        return attach(placed, targets, [*keys, "__b"]).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))

    while fullest > CANDIDATES:
        width = (F.col("__hi") - F.col("__lo")) / REFINE
        part = F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(REFINE - 1))
        part = F.when((F.col("__open") > CANDIDATES) & (width > 0), part).otherwise(F.lit(0))
        split = within(targets).groupBy(
            *keys, "__b", F.col("__lo").alias("__low"), "__before", "__n", "__want", part.alias("__f")
        ).agg(*tally)
        # at most 256 parts per bucket
        below = F.sum("__c").over(Window.partitionBy(*keys, "__low").orderBy("__f")) - F.col("__c")
        split = split.withColumn("__before", F.col("__before") + below)
        targets, left = holding(split, F.col("__want"))
        if left == fullest:
            break  # neighbouring values that no part can tell apart: the last pass counts them
        fullest = left

    held = within(targets).groupBy(*keys, "__b", F.col("__lo").alias("__low"), "__before", "__n", "__want", "__v").agg(F.count("*").alias("__c"))
    below = F.sum("__c").over(Window.partitionBy(*keys, "__low").orderBy("__v")) - F.col("__c")
    held = held.withColumn("__before", F.col("__before") + below)
    hits = held.select(
        *keys,
        "__n",
        "__v",
        F.explode(
            F.filter("__want", lambda r: (r > F.col("__before")) & (r <= F.col("__before") + F.col("__c")))
        ).alias("__r"),
    )
    # at most two ranks per percentile and key
    found = hits.groupBy(*keys, "__n").agg(
        F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__at")
    )
    out = [*keys, F.col("__n").alias("n")]
    for name, p in probs.items():
        pos = rank_position(F.col("__n"), p, kind)
        lo = F.element_at("__at", F.floor(pos).cast("long"))
        hi = F.element_at("__at", F.ceil(pos).cast("long"))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*out)


def group_ranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, per_octave: int = 4096
) -> DataFrame:
    """Average-tie rank of ``value`` within ``keys`` (1..n), as column ``out``.

    Bucket prefix sums give the offset and a window per (key, bucket) over the
    distinct values the rest, so neither a hot key nor one value shared by many
    rows is sorted in one task.  The ranks are joined back by value: without a
    shuffle of the rows while there are few distinct values, else by a join whose
    crowded values AQE splits.
    """
    keys = list(keys)
    rows = df.withColumn("__b", order_bucket(F.col(value), per_octave))
    values = rows.groupBy(*keys, "__b", value).agg(F.count("*").alias("__c"))
    counts = values.groupBy(*keys, "__b").agg(F.sum("__c").alias("__k"))
    before = F.sum("__k").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__k")
    offsets = settle(counts.select(*keys, "__b", before.alias("__before")))
    below = F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy(value)) - F.col("__c")
    ranks = settle(values.join(offsets, [*keys, "__b"]).select(
        *keys, "__b", value, (F.col("__before") + below + (F.col("__c") + 1) / 2.0).alias(out)
    ))
    return rows.join(ranks, [*keys, "__b", value]).drop("__b")
