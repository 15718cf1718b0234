"""Connected components of links that are too many for one machine.

Large-star and small-star steps in turn (each a grouping and a join) until the
edges are stars. Nodes are never gathered by component: a component of any size
is rows of (node, smallest node).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidate_funnel.session import cut

# Edges a task of a step handles; few edges need few tasks.
TASK_EDGES = 20_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node; the root is its component's smallest node.

    Self-links and nulls do not count. An edge of the result has its larger end
    first, which is what makes every step reduce or keep the number of edges.
    """
    pair = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    edges = cut(pair.where("x > y").distinct())
    tasks = max(1, math.ceil(edges.count() / TASK_EDGES))

    def written(frame: DataFrame) -> DataFrame:
        return cut(frame.coalesce(tasks))

    while True:
        # Minima are written out, so that a join on a node of many links reads two
        # shuffles and can be split where it is skewed.
        least = written(edges.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")))
        # Stars: every node has one edge down, and what it leads to has none.
        above = edges.select(F.col("y").alias("x")).join(least.select("x"), "x", "left_semi")
        if least.where("n > 1").isEmpty() and above.isEmpty():
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        small = edges.join(least.select("x", "m"), "x").where("y > m")
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges = written(small.union(least.select("x", F.col("m").alias("y"))).distinct())
        down = edges.groupBy("x").agg(F.min("y").alias("m"))
        ends = edges.select(F.col("y").alias("x")).distinct().withColumn("m", F.col("x"))
        least = written(down.union(ends).groupBy("x").agg(F.min("m").alias("m")))
        # Every edge from a node's smaller end to that end's smallest neighbour.
        large = edges.join(least.select(F.col("x").alias("y"), "m"), "y")
        large = large.select("x", F.col("m").alias("y")).where("x > y")
        edges = written(large.distinct())
