"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the least node it reaches.

    Each round ties every node's neighbours to the least of them, first the larger
    neighbours, then the smaller ones, until every edge leads to a root. A node's
    least neighbour is an aggregate and goes to a hub's edges by broadcast, so a node
    with very many edges isn't gathered in one task. Rounds are written to the shared
    folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    count = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), name)
        large = join_hot(both, least, ["a"], "n", 2 * count).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)
        met = join_hot(large, least, ["a"], "n", large.count())
        small = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        heads = small.select(F.col("b").alias("a")).distinct()
        # done when no node that is pointed at points on, and no node points at two
        count = small.count()
        if small.join(heads, "a", "left_semi").isEmpty() and small.select("a").distinct().count() == count:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(heads.select(F.col("a").alias("node"), F.col("a").alias("root")))
        now = small
