"""Node and edge tables of many graphs at once.

``nodes(graph_id, node_id, label, ...)`` and undirected simple
``edges(graph_id, src, dst, label)``. Both a whole graph and a single node may
be very large, so neighbourhoods are summed map-side, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.operators.skew import hot_join, parts_for

NODE = ["graph_id", "node_id"]
EDGE = ["graph_id", "src", "dst"]

# Parts in which the edges of one node are counted, in graphs of many edges.
HUB_PARTS = 64


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Each edge from both of its ends: ``(graph_id, node_id, other, ...)``."""
    ends = F.array(
        F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")),
    )
    return edges.select("graph_id", F.explode(ends).alias("_end"), *extra).select(
        "graph_id", "_end.node_id", "_end.other", *extra
    )


def induced(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that satisfy the condition and the edges among them."""
    kept = nodes.where(keep)
    ends = kept.select(*NODE)
    inside = edges
    for end in ("src", "dst"):
        inside = hot_join(inside, ends.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return kept, inside.select(*edges.columns)


def malformed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs with an edge to a node that is not listed: ``(graph_id)``."""
    ends = both_ways(edges).select(*NODE).distinct()
    return ends.join(nodes.select(*NODE), NODE, "left_anti").select("graph_id").distinct()


def strip_leaves(
    nodes: DataFrame, edges: DataFrame, bound: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Remove every node of degree one, once, with its edge.

    A leaf has a single edge, which the degree count finds along the way; both
    removals are therefore by unique key, whatever the degree of the hubs.
    ``bound`` is a number of edges the caller knows not to be exceeded; they are
    counted otherwise, since many of them take more and smaller tasks.
    """
    rows = edges.count() if bound is None else bound
    parts, edge_parts = parts_for(edges, 2 * rows), parts_for(edges, rows)
    ends = both_ways(edges, *EDGE[1:])
    firsts = [F.min(c).alias(c) for c in EDGE[1:]]
    if parts is None:
        degrees = ends.groupBy(*NODE).agg(F.count("*").alias("_degree"), *firsts)
    else:
        # A hub's edges are counted in parts, so that no task gets them all.
        slot = F.pmod(F.xxhash64("other"), F.lit(HUB_PARTS)).alias("_part")
        ends = ends.select(*NODE, *EDGE[1:], slot).repartition(parts, *NODE, "_part")
        counted = ends.groupBy(*NODE, "_part").agg(F.count("*").alias("_n"), *firsts)
        counted = counted.repartition(parts, *NODE).groupBy(*NODE)
        degrees = counted.agg(F.sum("_n").alias("_degree"), *firsts)
    leaves = degrees.where(F.col("_degree") == 1)
    kept = nodes.join(leaves.select(*NODE), NODE, "left_anti")
    # The edges follow the leaves into as many tasks.
    gone = leaves.select(*EDGE) if edge_parts is None else leaves.select(*EDGE).repartition(edge_parts, *EDGE)
    inner = edges.join(gone, EDGE, "left_anti")
    return kept, inner.select(*edges.columns)


def exchangeable_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, block): leaves of one node that bear one label, two or more.

    They may be exchanged freely, so they stand for the product of all their
    orders. Nodes are named by their place in node order, from 0.
    """
    degrees = both_ways(edges).groupBy(*NODE).agg(F.count("*").alias("_degree"), F.min("other").alias("_hub"))
    order = Window.partitionBy("graph_id").orderBy("node_id")
    placed = nodes.select(*NODE, "label", (F.row_number().over(order) - 1).alias("_place"))
    leaves = placed.join(degrees.where("_degree = 1"), NODE)
    found = leaves.groupBy("graph_id", "_hub", "label").agg(F.sort_array(F.collect_list("_place")).alias("block"))
    return found.where(F.size("block") > 1).select("graph_id", "block")


def symmetry_guard(
    keyed: DataFrame, mappings: DataFrame, keys: Sequence[str], cap: int = 5000, swaps: DataFrame | None = None
) -> DataFrame:
    """``(keys, n_capped, use_core)``: whether a key has too many mappings.

    Counts stop at ``cap``; at the cap the stripped core is to be measured.
    ``swaps(keys, block)`` multiplies a key's mappings by the orders of each set.
    """
    counted = mappings.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = keyed.select(*keys).distinct().join(counted, list(keys), "left")
    total = F.coalesce(F.col("_n"), F.lit(0)).cast("double")
    if swaps is not None:
        # Beyond 20 atoms the orders exceed any cap, and the largest long.
        orders = F.factorial(F.least(F.size("block"), F.lit(20)))
        factors = swaps.groupBy(*keys).agg(F.product(orders.cast("double")).alias("_f"))
        joined = joined.join(factors, list(keys), "left")
        # A graph without listed mappings still has the identity.
        total = F.when(F.col("_f").isNull(), total).otherwise(F.greatest(total, F.lit(1.0)) * F.col("_f"))
    capped = F.least(total, F.lit(float(cap))).cast("bigint")
    return joined.select(*keys, capped.alias("n_capped")).withColumn("use_core", F.col("n_capped") >= cap)


def node_coords(
    df: DataFrame,
    keys: Sequence[str],
    kept: DataFrame,
    coords: str = "coords",
    dims: int = 3,
    name: str = "metric",
) -> DataFrame:
    """Add ``name``, the coordinates of the kept nodes only, in node order.

    ``kept(keys, node_id)`` numbers the atoms from 0. A row whose coordinates
    end before or inside one of its key's nodes gets a null.
    """
    keys = list(keys)
    # Lists of nodes are made for keys at hand, and no longer than their arrays plus one.
    atoms = df.groupBy(*keys).agg(F.max(F.size(coords) / dims).alias("_size"))
    placed = hot_join(kept.select(*keys, "node_id"), atoms, keys)
    inside = placed.select(*keys, F.least("node_id", F.ceil("_size")).alias("node_id"))
    listed = inside.groupBy(*keys).agg(F.sort_array(F.collect_set("node_id")).alias("_atoms"))
    chosen = F.flatten(
        F.transform("_atoms", lambda a: F.slice(coords, (a * dims + 1).cast("int"), F.lit(dims)))
    )
    empty = F.slice(coords, 1, 0)
    whole = (F.array_max("_atoms") + 1) * dims <= F.size(coords)
    chosen = F.when(whole, chosen)
    return (
        hot_join(df, listed, keys, "left")
        .withColumn(name, F.when(F.col("_atoms").isNull(), empty).otherwise(chosen))
        .drop("_atoms")
    )


def atom_numbers(nodes: DataFrame, number: str = "number") -> DataFrame:
    """``(graph_id, numbers)``: each molecule's numbers in node order.

    Meant for graphs whose coordinates are arrays of one row, as long as these.
    """
    ordered = F.array_sort(F.collect_list(F.struct("node_id", number)))
    listed = nodes.groupBy("graph_id").agg(ordered.alias("_l"))
    return listed.select("graph_id", F.transform("_l", lambda x: x[number]).alias("numbers"))


def graph_totals(nodes: DataFrame) -> DataFrame:
    """Total charge, spin multiplicity and node count of each graph."""
    return nodes.groupBy("graph_id").agg(
        F.sum("charge").alias("charge"),
        (F.sum("radicals") + 1).alias("multiplicity"),
        F.count("*").alias("n_nodes"),
    )
