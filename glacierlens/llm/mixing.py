"""Mixing sources to target weights by hierarchical budgets.

Weights stand at the nodes of a tree, here domain, language and source; a node
shares its tokens among its children by weight.  A leaf can give as many tokens
as it has, times the allowed epochs.  What a leaf lacks goes to its siblings,
and only what a whole family lacks goes to the family's siblings.

A leaf's documents come in a seeded order for each epoch.  Whole epochs are
taken first, then the documents of the next one whose tokens fit the rest of the
budget from the front.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glacierlens.llm.tables import fresh, written
from glacierlens.llm.tokens import default_encoder

SEED = 20_240
EPOCHS = 2
# a leaf's order is cut into 2**SLOT_BITS slots, and so is the slot at the budget's end, LEVELS
# times in all; only what that leaves is sorted
SLOT_BITS = 6
LEVELS = 2


@F.pandas_udf(T.LongType())
def token_count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function: tokens of a whole text; null counts as empty."""
    encoder = default_encoder()
    for batch in texts:
        yield pd.Series([encoder.count(t) if t else 0 for t in batch], dtype="int64")


def share(total: float, weights: dict, room: dict) -> dict:
    """Split ``total`` among siblings by weight, none beyond its room.

    What a full sibling can't take goes to the others by weight.  The sum is less
    than ``total`` only if all siblings of positive weight are full.
    """
    got = dict.fromkeys(weights, 0.0)
    open_ = sorted((k for k in weights if weights[k] > 0 and room[k] > 0), key=str)
    while open_ and total > 0:
        scale = total / sum(weights[k] for k in open_)
        full = [k for k in open_ if room[k] <= weights[k] * scale]
        if not full:
            for k in open_:
                got[k] = weights[k] * scale
            break
        for k in full:
            got[k] = float(room[k])
            total -= room[k]
        open_ = [k for k in open_ if k not in full]
    return got


def budgets(room: dict[tuple, float], total: float, weight) -> dict[tuple, int]:
    """Tokens of each leaf.  ``room`` maps a leaf's path to what it can give at most.

    ``weight(path)`` is a node's weight among its siblings.  A node's room is the
    sum of its children's, leaving out children without weight.
    """
    depth = len(next(iter(room), ()))
    rooms: dict[tuple, float] = {}
    for path, tokens in room.items():
        if all(weight(path[:i]) > 0 for i in range(1, depth + 1)):
            for i in range(depth + 1):
                rooms[path[:i]] = rooms.get(path[:i], 0) + tokens
    given = {(): min(float(total), rooms.get((), 0.0))}
    for level in range(depth):
        for parent in [p for p in given if len(p) == level]:
            children = [p for p in rooms if len(p) == level + 1 and p[:level] == parent]
            given |= share(given[parent], {p: weight(p) for p in children}, rooms)
    return {p: int(given.get(p, 0)) for p in room}


def leaf_tokens(docs: DataFrame, levels: list[str], tokens: str) -> dict[tuple, int]:
    """Tokens of each leaf of the tree: one number for each source of each language."""
    rows = docs.groupBy(*levels).agg(F.sum(tokens).alias("n")).collect()
    return {tuple(r[:-1]): int(r[-1] or 0) for r in rows}


def _at_ends(rows: DataFrame, ends: DataFrame, names: list[str]) -> DataFrame:
    """Rows with their leaf's end slot; there is one row of ``ends`` for each leaf."""
    named = [f"end_{n}" for n in names]
    return rows.join(F.broadcast(ends.toDF(*named, "end", "before")), [F.col(n).eqNullSafe(F.col(m)) for n, m in zip(names, named, strict=True)])


def select(docs: DataFrame, levels: list[str], tokens: str, key: Column, plan: dict[tuple, int], seed: int = SEED) -> DataFrame:
    """Documents of each leaf's whole epochs and of its last epoch's prefix, with ``epoch``.

    A document comes once for each epoch that takes it.  Documents without tokens
    are in every epoch that is whole, or whose prefix reaches them.  Null levels
    are a leaf of their own.  Rows of one key in one leaf are ordered by their text.
    """
    spark = docs.sparkSession
    epoch = fresh(docs, "epoch")
    have = leaf_tokens(docs, levels, tokens)
    rows = [(*path, n // have[path] if have[path] else 0, n % have[path] if have[path] else 0) for path, n in plan.items()]
    kinds = dict(docs.dtypes)
    names = [f"leaf_{i}" for i in range(len(levels))]
    schema = ", ".join(f"at_{n} {kinds[c]}" for n, c in zip(names, levels, strict=True)) + ", whole long, rest long"
    # as many rows as there are leaves: sources of a language, whatever the number of documents
    leaves = F.broadcast(spark.createDataFrame(rows, schema))
    # a document's own columns travel in one, whatever their names
    tree = [F.col(c).alias(n) for n, c in zip(names, levels, strict=True)]
    packed = docs.select(F.struct("*").alias("row"), *tree, F.col(tokens).alias("tokens"), key.alias("key"), F.xxhash64("text").alias("text_hash"))
    matched = packed.join(leaves, [F.col(n).eqNullSafe(F.col(f"at_{n}")) for n in names])
    many = matched.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    ordered = many.withColumn("order", F.xxhash64("key", F.lit(seed), F.col("epoch")))
    full = ordered.where("epoch < whole")
    # the last epoch: slots before the budget's end are in, the slot at the end is cut again or sorted
    last = ordered.where("epoch = whole and rest > 0")
    ends = None
    for level in range(1, LEVELS + 1):
        slots = last.withColumn("slot", F.shiftrightunsigned("order", 64 - level * SLOT_BITS))
        cut = slots.withColumn("before", F.lit(0)) if ends is None else _at_ends(slots, ends, names).where(F.shiftright("slot", SLOT_BITS) == F.col("end"))
        sums = cut.groupBy(*names, "slot", "rest", "before").agg(F.sum("tokens").alias("slot_tokens"))
        earlier = F.sum("slot_tokens").over(Window.partitionBy(*names).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        edges = sums.withColumn("before", F.col("before") + F.coalesce(earlier, F.lit(0))).where("before <= rest")
        ends = written(edges.groupBy(*names).agg(F.max("slot").alias("end"), F.max_by("before", "slot").alias("before")), "ends")
    last = _at_ends(slots, ends, names)
    inside = last.where("slot < end")
    running = F.sum("tokens").over(Window.partitionBy(*names).orderBy("order", "key", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    at_end = last.where("slot = end").withColumn("so_far", F.col("before") + running).where("so_far <= rest")
    columns = ["row.*", F.col("epoch").cast("int").alias(epoch)]
    return full.select(*columns).unionByName(inside.select(*columns)).unionByName(at_end.select(*columns))


def mix(docs: DataFrame, levels: list[str], total: float, weight, key: str = "doc_id", epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Mix documents to weights: all their columns, ``epoch`` and ``n_tokens``.

    ``total`` is the share of all tokens that the mix holds; more than 1 needs epochs.
    """
    tokens = fresh(docs, "n_tokens")
    counted = written(docs.withColumn(tokens, token_count("text")), "counted")
    have = leaf_tokens(counted, levels, tokens)
    plan = budgets({p: n * epochs for p, n in have.items()}, total * sum(have.values()), weight)
    return select(counted, levels, tokens, F.col(key), plan, seed)
