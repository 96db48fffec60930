"""Connected components by contraction, for class ids of linked documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of edges `a, b`; component is the least node that is reachable.

    Each round orders nodes by a hash of its own, sends every node to its first neighbour if that comes before it,
    renames the edges' ends and drops those within one node; what is left is a smaller graph. In such an order a path of any
    numbering shrinks by a share, so rounds are about as many as the logarithm of the longest path; they end when no edge is
    left. Neighbours are combined before the shuffle; all tables stay distributed and each round is written to
    the shared folder, so a lost executor repeats little, and plans and Spark's estimates of sizes start anew. Loops and repeated edges are harmless,
    edges with a null end are dropped, no edges give no rows.
    """
    live = written(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known, number = None, 0
    while not live.isEmpty():
        both = F.array(F.struct(F.col("a").alias("a"), F.col("a").alias("to")), F.struct(F.col("a"), F.col("b").alias("to")), F.struct(F.col("b").alias("a"), F.col("a").alias("to")), F.struct(F.col("b").alias("a"), F.col("b").alias("to")))
        ends = live.select(F.inline(both))
        moved = written(ends.groupBy(F.col("a").alias("node")).agg(F.min_by("to", F.xxhash64("to", F.lit(number))).alias("to")))
        number += 1
        jump = moved.select(F.col("node").alias("_n"), F.col("to").alias("_t")).filter("_n <> _t")
        moved = written(moved.join(jump, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to")))
        if known is None:
            known = moved.select("node", F.col("to").alias("component"))
        else:
            step = moved.withColumnRenamed("node", "_n")
            known = known.join(step, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("to", "component").alias("component"))
        known = written(known)
        left, right = moved.select(F.col("node").alias("a"), F.col("to").alias("_a")), moved.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        live = live.join(left, "a").join(right, "b").filter("_a <> _b")
        live = written(live.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if known is not None:
        least = known.groupBy("component").agg(F.min("node").alias("_least"))
        return known.join(least, "component").select("node", F.col("_least").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
