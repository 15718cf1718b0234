import random

import pytest
from pyspark.sql import functions as F

from candidate_funnel.operators import fingerprint as fp
from candidate_funnel.operators import graph

# Heavy-atom skeletons: (labels, bonds).
RING = [(i, (i + 1) % 6) for i in range(6)]
GRAPHS = {
    "plain": ("C" * 7, [*RING, (0, 6)]),
    "no_terminals": ("C" * 6, RING),
    "branched": ("C" * 9, [*RING, (0, 6), (6, 7), (6, 8)]),
    "symmetric": (
        "CCCCC" + "F" * 12,
        [(0, i) for i in range(1, 5)] + [(1 + i // 3, 5 + i) for i in range(12)],
    ),
    "joined": ("CO", [(0, 1)]),
    "lone": ("C", []),
}
MAPPINGS = {"plain": 2, "no_terminals": 12, "branched": 4, "symmetric": 31104}


def frames(spark, graphs):
    nodes = [(g, i, c, 0, 0) for g, (labels, _) in graphs.items() for i, c in enumerate(labels)]
    edges = [(g, a, b, "1") for g, (_, bonds) in graphs.items() for a, b in bonds]
    return (
        spark.createDataFrame(nodes, "graph_id string, node_id int, label string, charge int, radicals int"),
        spark.createDataFrame(edges, "graph_id string, src int, dst int, label string"),
    )


def counts(df):
    return {r.graph_id: r["count"] for r in df.groupBy("graph_id").count().collect()}


def test_leaves_go_once(spark):
    nodes, edges = graph.strip_leaves(*frames(spark, GRAPHS))
    assert counts(nodes) == {"plain": 6, "no_terminals": 6, "branched": 7, "symmetric": 5, "lone": 1}
    assert counts(edges) == {"plain": 6, "no_terminals": 6, "branched": 7, "symmetric": 4}


def test_induced_keeps_inner_edges(spark):
    nodes, edges = graph.induced(*frames(spark, GRAPHS), F.col("label") == "C")
    assert counts(nodes)["symmetric"] == 5
    assert counts(edges)["symmetric"] == 4
    assert "joined" not in counts(edges)


@pytest.mark.parametrize("cap,stripped", [(5000, {"symmetric"}), (10**6, set()), (12, {"no_terminals", "symmetric"})])
def test_guard_fires_at_the_cap_and_reports(spark, cap, stripped):
    nodes, _ = frames(spark, GRAPHS)
    sizes = spark.createDataFrame(list(MAPPINGS.items()), "graph_id string, n int")
    mappings = sizes.select("graph_id", F.explode(F.sequence(F.lit(1), "n")).alias("mapping_id"))
    out = graph.symmetry_guard(nodes.select("graph_id"), mappings, ["graph_id"], cap).collect()
    assert {r.graph_id for r in out if r.use_core} == stripped
    assert all(r.n_capped == min(MAPPINGS.get(r.graph_id, 0), cap) for r in out)
    assert len(out) == len(GRAPHS)


def test_kept_atoms_keep_their_coordinates(spark):
    nodes, edges = frames(spark, {"branched": GRAPHS["branched"], "joined": GRAPHS["joined"]})
    pool = spark.createDataFrame(
        [("branched", 1, [float(i) for i in range(27)]), ("joined", 2, [1.0] * 6)],
        "graph_id string, cand_id bigint, coords array<double>",
    )
    core, _ = graph.strip_leaves(nodes, edges)
    out = {r.graph_id: r for r in graph.node_coords(pool, ["graph_id"], core).collect()}
    assert out["branched"].metric == [float(i) for i in range(21)]
    assert len(out["branched"].coords) == 27
    assert out["joined"].metric == []


def test_malformed(spark):
    nodes, edges = frames(spark, GRAPHS)
    bad = graph.malformed(nodes.where("not (graph_id = 'plain' and node_id = 3)"), edges)
    assert [r.graph_id for r in bad.collect()] == ["plain"]


def test_totals(spark):
    nodes = spark.createDataFrame(
        [("a", 0, 1, 0), ("a", 1, -2, 1), ("b", 0, 0, 0)], "graph_id string, node_id int, charge int, radicals int"
    )
    out = {r.graph_id: r for r in graph.graph_totals(nodes).collect()}
    assert (out["a"].charge, out["a"].multiplicity, out["a"].n_nodes) == (-1, 2, 2)
    assert (out["b"].charge, out["b"].multiplicity) == (0, 1)


def expected_groups(labels, bonds, radius):
    """Environments by definition: covered edge sets, kept at their smallest radius."""
    n = len(labels)
    nbrs = {i: set() for i in range(n)}
    for a, b in bonds:
        nbrs[a].add(b)
        nbrs[b].add(a)
    ball = {i: {i} for i in range(n)}
    first = {}
    for r in range(1, radius + 1):
        for v in range(n):
            if nbrs[v]:
                cover = frozenset(frozenset(e) for e in bonds if ball[v] & set(e))
                first.setdefault(cover, r)
        ball = {v: set.union(ball[v], *(nbrs[u] for u in ball[v])) for v in range(n)}
    return first


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_environments_cover_each_edge_set_once(spark, radius):
    rnd = random.Random(radius)
    graphs = dict(GRAPHS)
    for i in range(6):
        n = 9
        bonds = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.15 + 0.08 * i]
        graphs[f"g{i}"] = ("".join(rnd.choice("CNO") for _ in range(n)), bonds)
    out = fp.environments(*frames(spark, graphs), radius).where("radius > 0")
    got = {}
    for r in out.collect():
        got.setdefault(r.graph_id, []).append(r.radius)
    want = {g: sorted(expected_groups(*spec, radius).values()) for g, spec in graphs.items()}
    assert {g: sorted(v) for g, v in got.items()} == {g: v for g, v in want.items() if v}


def test_fingerprint_ignores_numbering(spark):
    labels, bonds = "CCNOCCF", [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (0, 2), (5, 6)]
    order = [4, 6, 0, 2, 5, 1, 3]
    again = "".join(labels[order.index(i)] for i in range(7))
    moved = [(order[b], order[a]) for a, b in bonds]
    bits = fp.fingerprint(*frames(spark, {"a": (labels, bonds), "b": (again, moved)}))
    sets = {}
    for r in bits.collect():
        sets.setdefault(r.graph_id, set()).add(r.bit)
    assert sets["a"] == sets["b"]


def test_hub_is_summed_not_collected(spark):
    spokes = ("C" + "F" * 3000, [(0, i) for i in range(1, 3001)])
    out = fp.environments(*frames(spark, {"hub": spokes}))
    # Spokes cover one edge each; the hub, and every spoke at radius 2, all.
    assert out.where("radius = 1").count() == 3001
    assert out.where("radius = 2").count() == 0


def test_dense_rows(spark):
    nodes, edges = frames(spark, GRAPHS)
    empty = spark.createDataFrame([("none",)], "graph_id string")
    bits = fp.fingerprint(nodes, edges, n_bits=128)
    dense = fp.densify(bits, nodes.select("graph_id").union(empty), 128)
    rows = {r.graph_id: r.features for r in dense.collect()}
    assert sum(rows.pop("none")) == 0
    want = {}
    for r in bits.collect():
        want.setdefault(r.graph_id, set()).add(r.bit)
    assert all(len(v) == 128 and {i for i, x in enumerate(v) if x} == want[g] for g, v in rows.items())


def test_radius_must_not_be_negative(spark):
    with pytest.raises(ValueError):
        fp.fingerprint(*frames(spark, GRAPHS), radius=-1)
