"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glacierlens.llm.tables import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for each node of the edges ``a, b``; ``comp`` is the smallest node reachable.

    Each round points every node to its smallest neighbour's pointer and keeps
    one edge between the groups this makes, until no edge is left.  Sums and
    minima combine before each shuffle, so a node with many edges is no hot key.
    """
    rest = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, done = None, []
    while not rest.isEmpty():
        both = rest.select("a", "b").union(rest.select("b", "a"))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "nearest")
        far = near.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = written(near.join(far, "comp").select("node", F.col("up").alias("comp")), "step")
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            before = labels
            labels = written(before.join(further, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
            done += [before, step]
        a = step.select(F.col("node").alias("a"), F.col("comp").alias("x"))
        b = step.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        moved = rest.join(a, "a").join(b, "b").where("x <> y")
        done += [near, rest]
        rest = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(*done)
        done = []
    return rest.select(F.col("a").alias("node"), F.col("b").alias("comp")) if labels is None else labels
