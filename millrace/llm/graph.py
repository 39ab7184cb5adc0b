"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of `edges` (a, b), both long; root is the smallest end of the component.

    Rounds of large and small stars: every node hands its larger, then its smaller neighbours over to the smallest one.
    The number of rounds grows with the logarithm of the longest path, and no round has more edges than the first by
    more than the number of nodes. Each round's edges are a written table. Neither side of a join has a known bound, so
    none is broadcast. The sums are written before they are joined: a join right behind its own aggregation could not be
    split at a hub with very many edges.
    """
    one = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("e")
    edges = checkpoint(edges.where("a != b").select(one).distinct().select("e.a", "e.b"))
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        large = checkpoint(large)
        # Now a < b: node b hands the neighbours below it, and itself, to the smallest of them.
        lowest = checkpoint(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(lowest.hint("merge"), "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = checkpoint(small.unionByName(lowest.select(F.col("m").alias("a"), "b")).distinct())
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return edges.select(F.col("b").alias("v"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct())
