"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named
    by its smallest node.

    Alternates large-star and small-star steps until the edges stand still:
    every step hangs nodes below the smallest neighbour that is known, which
    takes a number of rounds logarithmic in the longest path.  A round groups by
    node with partial minima and joins the minima back, so a node with very many
    neighbours is pre-aggregated on one side and splittable on the other."""
    both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct()
    both = materialize(both, "edges")
    state = None
    while True:
        # Large star: every larger neighbour hangs below the smallest of a node's neighbourhood.
        around = both.union(both.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = around.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("low"))
        large = around.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("low").alias("u")).distinct()
        # Small star: a node and its smaller neighbours hang below the smallest of them.
        below = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(below, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("low").alias("u")), F.struct("v", F.col("low").alias("u")))).alias("e")).select("e.v", "e.u")
        both = materialize(small.where("v > u").distinct(), "stars")
        now = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return both.select(F.col("v").alias("node"), F.col("u").alias("component")).union(both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
