"""Connected components of a graph given as edges, by alternating large and small stars.

Each round points the neighbours of a node that are larger (then: smaller) than it at the least node around, until every component is a star around its least
node; the number of rounds grows with the logarithm of the graph. A hub is only ever grouped by partial aggregation and joined from the side that AQE can split.
Joins are merge joins at any size: rounds are many, and each table broadcast in one would stay in the driver until its garbage is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehist.llm.tables import staged


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has one edge to a smaller node and none to a larger one, or none to a smaller one; the edges (a, b) have a > b and are distinct."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1)))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node of the edges (a, b); loops and double edges don't matter."""
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least.hint("merge"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return staged(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()))
