"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.stored import narrow


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b: long); a component is named by its smallest node.

    Alternates the two star steps: each node ties its larger neighbours to its
    smallest one, then its smaller ones. Every step is a map-side minimum and a
    join whose two inputs are stored tables, so a hub with a third of all edges
    can be split. Rounds grow with the logarithm of the longest path. Null
    ends and loops are skipped; no edges give no rows.
    """
    tied = narrow(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while True:
        both = tied.unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = narrow(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = narrow(large.distinct(), "large")
        least = narrow(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = narrow(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "tied")
        # done when the edges are stars: every larger end has one edge and is no smaller end
        ends = tied.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            tied.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            roots = tied.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return tied.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
