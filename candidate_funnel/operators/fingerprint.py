"""Circular neighbourhood fingerprints of graphs, folded to a bit vector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.operators.graph import NODE, both_ways, malformed
from candidate_funnel.operators.skew import find_hot, hot_join
from candidate_funnel.session import cut


# Edges of a node, where an environment's edges are listed as rows.
MOST_DEGREE = 1000


def code(*parts: Column) -> Column:
    """60-bit code of a text, from the leading hex digits of its md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _total(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)"))


def _closing(edges: DataFrame, degrees: DataFrame, hubs: DataFrame | bool) -> DataFrame:
    """Per node, count and sum of the edges that join two of its neighbours.

    Edges run from the end of lower degree to the other, which leaves even a
    hub few outgoing ones to pair up.
    """
    low = degrees.select("graph_id", F.col("node_id").alias("src"), F.col("size").alias("_ds"))
    high = degrees.select("graph_id", F.col("node_id").alias("dst"), F.col("size").alias("_dd"))
    with_low = hot_join(
        edges, low, ["graph_id", "src"], hot=hubs and hubs.withColumnRenamed("other", "src")
    )
    turned = F.struct("_ds", "src") > F.struct("_dd", "dst")
    directed = (
        hot_join(with_low, high, ["graph_id", "dst"], hot=hubs and hubs.withColumnRenamed("other", "dst"))
        .select(
            "graph_id",
            F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("p"),
            F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("q"),
            "edge",
        )
    )
    wedge = directed.select("graph_id", "p", F.col("q").alias("x"), F.col("edge").alias("px")).join(
        directed.select("graph_id", "p", F.col("q").alias("y"), F.col("edge").alias("py")),
        ["graph_id", "p"],
    )
    third = directed.select("graph_id", F.col("p").alias("x"), F.col("q").alias("y"), F.col("edge").alias("xy"))
    triangle = wedge.where(F.col("x") != F.col("y")).join(third, ["graph_id", "x", "y"])
    seen = F.array(
        F.struct(F.col("p").alias("node_id"), F.col("xy").alias("edge")),
        F.struct(F.col("x").alias("node_id"), F.col("py").alias("edge")),
        F.struct(F.col("y").alias("node_id"), F.col("px").alias("edge")),
    )
    return (
        triangle.select("graph_id", F.explode(seen).alias("_s"))
        .groupBy("graph_id", F.col("_s.node_id").alias("node_id"))
        .agg(F.count("*").alias("_closing"), F.sum(F.col("_s.edge").cast("decimal(20,0)")).alias("_closed"))
    )


class _Listed:
    """Edges that each node covers, as rows, round by round.

    A round joins only the edges first reached in the round before: what a node
    reaches at distance r + 1, one of its neighbours reaches at r and no sooner.
    The rows grow with the product of degrees; only radii above 2 need them, and
    a node of more than ``MOST_DEGREE`` edges is refused there.
    """

    def __init__(self, links: DataFrame):
        top = links.groupBy(*NODE).count().agg(F.max("count")).first()[0] or 0
        if top > MOST_DEGREE:
            raise ValueError(f"a node has {top} edges; radii above 2 take at most {MOST_DEGREE}")
        self.links = links.select(*NODE, "other")
        self.frontier = links.select(*NODE, "edge")
        self.covered, self.reach = self.frontier, 1

    def within(self, radius: int) -> DataFrame:
        """Number and code sum of the edges within ``radius``, not less than before."""
        while self.reach < radius:
            nearer = self.frontier.withColumnRenamed("node_id", "other")
            met = self.links.join(nearer, ["graph_id", "other"]).select(*NODE, "edge").distinct()
            self.frontier = cut(met.join(self.covered, [*NODE, "edge"], "left_anti"))
            self.covered = self.covered.unionByName(self.frontier)
            self.reach += 1
        return self.covered.groupBy(*NODE).agg(F.count("*").alias("size"), _total("edge").alias("covered"))


def environments(nodes: DataFrame, edges: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct environments ``(graph_id, radius, code)`` of every graph.

    Each node starts from its label and takes in, once per bond of radius, the
    multiset of its neighbours' codes, as a count and a sum. Environments that
    cover the same edges of a graph count once: the smallest radius wins, then
    the smallest code. Single nodes cover no edge and always count.

    What an environment covers is known by the number of its edges and the sum
    of their codes: at radius 1 the incident edges; at radius 2 also those of
    the neighbours, less what that counts twice, so no edge set is listed.
    """
    if radius < 0:
        raise ValueError("radius must not be negative")
    listed = None
    labelled = edges.withColumn(
        "edge", code(F.least("src", "dst"), F.greatest("src", "dst"))
    ).withColumnRenamed("label", "bond")
    links = both_ways(labelled, "bond", "edge")
    end = ["graph_id", "other"]
    hubs = find_hot(links, end)
    none = F.lit(0)
    current = nodes.select(
        *NODE,
        code(F.col("label")).alias("code"),
        none.cast("bigint").alias("size"),
        none.cast("decimal(38,0)").alias("covered"),
    )
    rounds = [current]
    for reach in range(1, radius + 1):
        message = code(F.col("bond"), F.col("code"))
        around = (
            hot_join(links, current.withColumnRenamed("node_id", "other"), end, hot=hubs)
            .groupBy(*NODE)
            .agg(
                F.count("*").alias("_n"),
                _total(message).cast("decimal(38,0)").alias("_sum"),
                _total("edge").alias("_edges"),
                F.sum("size").alias("_sizes"),
                F.sum("covered").alias("_covers"),
            )
        )
        grown = current.join(around, NODE)
        if reach == 1:
            size, covered = F.col("_n"), F.col("_edges")
        elif reach == 2:
            # A neighbour's own edges, without the one that leads to it.
            grown = grown.join(_closing(labelled, current, hubs), NODE, "left")
            size = F.col("size") + F.col("_sizes") - F.col("_n") - F.coalesce("_closing", none)
            covered = F.col("covered") + F.col("_covers") - F.col("_edges") - F.coalesce("_closed", none)
        else:
            listed = listed or _Listed(links)
            grown = grown.drop("size", "covered").join(listed.within(reach), NODE)
            size, covered = F.col("size"), F.col("covered")
        current = grown.select(
            *NODE,
            code(F.lit(reach), F.col("code"), F.col("_n"), F.col("_sum")).alias("code"),
            size.alias("size"),
            covered.cast("decimal(38,0)").alias("covered"),
        )
        if reach < radius:
            current = cut(current)
        rounds.append(current)
    found = rounds[0].select("graph_id", none.alias("radius"), "code").distinct()
    if radius == 0:
        return found
    rows = [df.withColumn("radius", F.lit(r)) for r, df in enumerate(rounds) if r]
    once = (
        reduce(DataFrame.unionByName, rows)
        .groupBy("graph_id", "size", "covered")
        .agg(F.min(F.struct("radius", "code")).alias("_first"))
    )
    return found.unionByName(once.select("graph_id", "_first.radius", "_first.code"))


def fingerprint(
    nodes: DataFrame, edges: DataFrame, radius: int = 2, n_bits: int = 2048, strict: bool = False
) -> DataFrame:
    """Set bits of every graph: ``(graph_id, bit)``.

    ``strict`` raises on the first graph with an edge to a node that is not
    listed; otherwise such edges count for the end that is.
    """
    if strict:
        first = malformed(nodes, edges).agg(F.min("graph_id"), F.count("*")).first()
        if first[1]:
            raise ValueError(f"{first[1]} graphs have edges to unlisted nodes, the first is {first[0]}")
    found = environments(nodes, edges, radius)
    return found.select("graph_id", (F.col("code") % n_bits).cast("int").alias("bit")).distinct()


def densify(bits: DataFrame, graphs: DataFrame, n_bits: int = 2048) -> DataFrame:
    """One float array of zeros and ones per graph, also for graphs without bits."""
    message = F.format_string("bit %d does not fit into %d", F.col("bit"), F.lit(n_bits))
    fits = F.when(F.col("bit") < n_bits, F.col("bit")).otherwise(F.raise_error(message).cast("int"))
    bits = bits.withColumn("bit", fits)
    ordered = bits.groupBy("graph_id").agg(F.sort_array(F.collect_set("bit")).alias("_bits"))
    stops = F.concat(F.coalesce("_bits", F.array().cast("array<int>")), F.array(F.lit(n_bits)))

    def piece(stop: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("_stops", i - 1))
        return F.concat(
            F.array_repeat(F.lit(0.0).cast("float"), stop - before - 1),
            F.array(F.lit(1.0).cast("float")),
        )

    return (
        graphs.select("graph_id")
        .distinct()
        .join(ordered, "graph_id", "left")
        .withColumn("_stops", stops)
        .select(
            "graph_id",
            F.slice(F.flatten(F.transform("_stops", piece)), 1, n_bits).alias("features"),
        )
    )
