"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``links(a, b)``.

    Large-star and small-star steps by turns: each keeps the components and
    brings nodes nearer to their smallest neighbour, until every edge leads to
    a component's smallest node.  Minima are aggregated before they are joined
    back, so that a node with many neighbours is no burden for one task.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    settled = False
    while not settled:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest.hint("merge"), "u")
        small = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        drop_cut(edges, least, large, lowest)
        # Done when every node has one edge, to a node that has none of its own.
        n_edges, n_nodes = small.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        edges = small
        settled = n_edges == n_nodes and edges.join(edges.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").isEmpty()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
