"""Best RMSD measured in tiles: factored mappings, pivots, clusters without pair rows."""

from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from candidate_funnel.operators import alignment, graph
from candidate_funnel.operators.alignment import BestRmsd, Orders, best_rmsd, in_range, matched, pack_symmetry
from candidate_funnel.operators.greedy import keep_first, leader_cluster
from candidate_funnel.operators.neighbours import Gate, by_distance, with_cells
from candidate_funnel.plans.funnel import guarded_symmetry, run_funnel
from candidate_funnel.session import cut

SCHEMA = "key string, cand_id bigint, score double, coords array<double>"


def rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_matching_is_the_best_of_all_orders(k):
    cost = np.random.default_rng(k).random((20, k, k))
    want = [min(sum(c[r, p[r]] for r in range(k)) for p in permutations(range(k))) for c in cost]
    assert matched(cost) == pytest.approx(want)


@pytest.mark.parametrize("align", [True, False])
def test_factors_are_their_product(align):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 7, 3)), rng.normal(size=(30, 7, 3))
    perms = np.array([[0, 1, 2, 3, 4, 5, 6], [1, 0, 4, 5, 2, 3, 6]])
    blocks = (np.array([2, 3]), np.array([4, 5]))
    factored = Orders(perms, blocks)
    explicit = []
    for p in perms:
        for x, y in product(permutations([2, 3]), permutations([4, 5])):
            order = np.arange(7)
            order[[2, 3]], order[[4, 5]] = x, y
            explicit.append(p[order])
    assert factored.closed() and len(explicit) == 8
    assert {tuple(o) for o in factored.each()} == {tuple(o) for o in explicit}
    assert best_rmsd(a, b, factored, align) == pytest.approx(best_rmsd(a, b, Orders(np.array(explicit)), align))


def crowds(rng, per=60, kinds=4, noise=0.02):
    base = rng.normal(size=(kinds, 6, 3))
    return np.array([(base[i % kinds] + rng.normal(0, noise, (6, 3))) @ rotation(rng) for i in range(per * kinds)])


@pytest.mark.parametrize("limit", [0.03, 0.05, 0.9])
def test_pivots_save_decompositions_and_nothing_else(monkeypatch, limit):
    x = crowds(np.random.default_rng(3))
    i, j = np.triu_indices(len(x), 1)
    orders = Orders(np.array([np.arange(6), [1, 0, 2, 3, 4, 5]]))
    counted = []
    plain = alignment.aligned_rmsd
    monkeypatch.setattr(alignment, "aligned_rmsd", lambda a, b: (counted.append(len(a)), plain(a, b))[1])
    with_pivots = in_range(x, i, j, orders, True, Gate(limit))
    spent, counted[:] = sum(counted), []
    monkeypatch.setattr(alignment, "PIVOT_PAIRS", 10**9)
    assert (with_pivots == in_range(x, i, j, orders, True, Gate(limit))).all()
    if limit != 0.03:
        # Near the noise itself bounds leave much open; apart from it they decide.
        assert spent * 2 <= sum(counted)
    assert with_pivots.any() and not with_pivots.all() or limit == 0.9


def test_open_sets_of_mappings_use_no_pivots():
    assert not Orders(np.array([[0, 1, 2], [1, 2, 0]])).closed()
    assert not Orders(np.array([[0, 1, 2, 3], [3, 2, 1, 0]]), (np.array([0, 1]),)).closed()


def frame(spark, x, key="a"):
    rows = [(key, i, float(i % 17), v.ravel().tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("align", [True, False])
def test_tiles_small_keys_and_listed_pairs_agree(spark, align):
    x = crowds(np.random.default_rng(5), per=20)
    df = frame(spark, x)
    maps = spark.createDataFrame([("a", [0, 1, 2, 3, 4, 5]), ("a", [1, 0, 2, 3, 4, 5])], "key string, perm array<int>")
    gate = Gate(0.06 if align else 0.9, dims=3)
    order = ["score", "cand_id"]
    pairs = alignment.pair_best_rmsd(df, ["key"], gate.rmsd, maps, align)
    want = {(r.cand_id, r.cluster_id) for r in leader_cluster(df, ["key"], order, gate, pairs=pairs).collect()}
    kept = {r.cand_id for r in keep_first(df, ["key"], order, gate, pairs=pairs).collect()}
    metric = BestRmsd("coords", 3, align, pack_symmetry(["key"], maps))
    for limit in (None, 10):
        got = leader_cluster(df, ["key"], order, gate, metric=metric, group_limit=limit)
        assert got.columns == [*df.columns, "cluster_id"]
        assert {(r.cand_id, r.cluster_id) for r in got.collect()} == want
        assert {r.cand_id for r in keep_first(df, ["key"], order, gate, metric=metric, group_limit=limit).collect()} == kept


def test_rotated_copies_write_no_pairs(spark, tmp_path, monkeypatch):
    """2,000 moved copies are 2 million pairs in range; no table of them is written."""
    import candidate_funnel.operators.greedy as greedy

    sizes = []
    plain = greedy.cut
    monkeypatch.setattr(greedy, "cut", lambda df: (lambda t: (sizes.append(t.count()), t)[1])(plain(df)))
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 3))
    df = frame(spark, [base @ rotation(rng) for _ in range(2000)])
    out = leader_cluster(df, ["key"], ["score", "cand_id"], Gate(0.01, dims=3), metric=BestRmsd()).collect()
    assert {r.cluster_id for r in out} == {0} and len(out) == 2000
    assert max(sizes) <= 2000


def test_leaves_of_a_node_multiply_the_mappings(spark):
    """A carbon with four carbons of three fluorines each: 24 orders times 6^4."""
    nodes = [("g", i, "C" if i < 5 else "F") for i in range(17)] + [("h", 0, "C"), ("h", 1, "C")]
    edges = [("g", 0, c) for c in range(1, 5)] + [("g", 1 + (f - 5) // 3, f) for f in range(5, 17)] + [("h", 0, 1)]
    n = spark.createDataFrame(nodes, "graph_id string, node_id int, label string")
    e = spark.createDataFrame(edges, "graph_id string, src int, dst int")
    blocks = graph.exchangeable_leaves(n, e)
    assert sorted(r.block for r in blocks.collect()) == [[5, 6, 7], [8, 9, 10], [11, 12, 13], [14, 15, 16]]
    cores = []
    for p in permutations(range(4)):
        order = [0, *(1 + k for k in p), *(5 + 3 * k + f for k in p for f in range(3))]
        cores.append(("g", order))
    maps = spark.createDataFrame(cores, "graph_id string, perm array<int>")
    for cap, use_core in ((5000, True), (31_104, True), (31_105, False)):
        rows = {r.graph_id: r for r in graph.symmetry_guard(n.select("graph_id"), maps, ["graph_id"], cap, blocks).collect()}
        assert rows["g"].use_core == use_core and rows["g"].n_capped == min(31_104, cap) and not rows["h"].use_core
    full = guarded_symmetry(graph.symmetry_guard(n.select("graph_id"), maps, ["graph_id"], 10**6, blocks), maps, maps.limit(0), blocks)
    packed = full.where("key = 'g'").collect()
    assert len(packed) == 1 and len(packed[0]["_perms"]) == 24 and len(packed[0]["_swaps"]) == 4
    # Exchanged leaves and turned branches are no distance at all.
    x = np.random.default_rng(8).normal(size=(17, 3))
    orders = Orders(np.array([c[1] for c in cores]), tuple(np.array(r) for r in packed[0]["_swaps"]))
    moved = x[orders.perms[13]].copy()
    moved[[5, 6, 7]] = moved[[7, 5, 6]]
    assert best_rmsd(moved[None], x[None], orders, False)[0] == pytest.approx(0, abs=1e-12)


def test_misfit_mappings_cost_their_key_only(spark):
    rows = [(k, i, 0, float(i), [float(i * j) for j in range(6)]) for k in ("good", "short", "beyond", "none") for i in range(3)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, status int, score double, coords array<double>")
    maps = spark.createDataFrame(
        [("good", [1, 0]), ("good", [0, 1]), ("short", [0]), ("beyond", [0, 2]), ("elsewhere", [0])], "key string, perm array<int>"
    )
    done = run_funnel(df, ["key"], mappings=maps, window=100.0, malformed=spark.createDataFrame([("none",)], "key string"))
    got = {r.key: r.outcome for r in done.outcomes().collect()}
    assert got == {"good": "ok", "short": "mappings_mismatch", "beyond": "mappings_mismatch", "none": "malformed_graph"}
    assert {r.key for r in done.ensemble.select("key").distinct().collect()} == {"good"}


def test_swaps_beyond_the_matrix_are_a_misfit(spark):
    atoms = spark.createDataFrame([(3, [[0, 1, 2]], [[1, 2]]), (3, [[0, 1, 2]], [[1, 3]]), (3, None, None)], "n int, _perms array<array<int>>, _swaps array<array<int>>")
    assert [r[0] for r in atoms.select(alignment.fits(F.col("n"))).collect()] == [True, False, True]


def test_pairs_measured_once_serve_all_rounds(spark):
    """Values reach the same neighbours as with measuring, also after rows have gone."""
    rng = np.random.default_rng(11)
    rows = [("k", n, 0.0, rng.normal(size=6).tolist()) for n in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.col("cand_id") + 1)
    maps = spark.createDataFrame([("k", [0, 1]), ("k", [1, 0])], "key string, perm array<int>")
    metric = BestRmsd("coords", 3, False, pack_symmetry(["key"], maps))
    gate = Gate(1.0, dims=3)
    indexed = df.withColumn("_index", metric.index())
    state = cut(with_cells(indexed, ["key"], metric.index_gate(gate), "_index", block_rows=32))
    near = by_distance(["key"], gate, "coords", None, 32, metric)
    kept = near.held(state)
    for left in (state, state.where("pos % 3 <> 0")):
        valued = left.withColumn("value", F.col("pos") * 7)
        for how in ("max", "sum"):
            want = {r.pos: r.value for r in near.reach(valued, how).collect()}
            got = {r.pos: r.value for r in kept.reach(valued, how).collect()}
            assert len(got) == left.count() and got == want
