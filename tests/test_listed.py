"""Clusters followed over listed neighbours, and ranges told by matrix products."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candidate_funnel.operators import alignment, greedy
from candidate_funnel.operators.alignment import BestRmsd, Orders, best_rmsd, pack_symmetry
from candidate_funnel.operators.greedy import crowded_first, followed, leader_cluster
from candidate_funnel.operators.neighbours import Gate


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 60), st.integers(0, 10**6), st.floats(0.2, 3.0), st.integers(1, 60), st.booleans())
def test_parts_follow_the_sequence(n, seed, reach, most, weighted):
    """The busiest ``most`` rows are asked for, their lists come in parts, until none is open."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= reach
    weight = rng.integers(1, 4, n) if weighted else np.ones(n, dtype=np.int64)
    pos = np.sort(rng.choice(1000, n, replace=False))
    last = int(pos[-1])
    shift = last.bit_length()
    open_rows, centre = np.ones(n, dtype=bool), np.full(n, -1)
    while open_rows.any():
        priority = np.where(open_rows, (near[:, open_rows] @ weight[open_rows]) << shift | last - pos, -1)
        asked = np.argsort(-priority)[: min(most, open_rows.sum())]
        least = int(priority[asked].min()) if len(asked) < open_rows.sum() else 0
        parts = []
        for row in rng.permutation(asked):
            own = rng.permutation(np.nonzero(near[row] & open_rows)[0])
            at = rng.integers(0, len(own) + 1)
            parts += [(row, own[:at]), (row, own[at:])]
        sizes = np.array([len(own) for _, own in parts])
        flat = np.concatenate([own for _, own in parts])
        rows, centres = followed(pos[[row for row, _ in parts]], sizes, pos[flat], weight[flat], shift, last, least)
        assert len(rows)
        told = np.searchsorted(pos, rows)
        assert open_rows[told].all()
        centre[told] = np.searchsorted(pos, centres)
        open_rows[told] = False
    assert (centre == crowded_first(near, weight)).all()


def clusters(rows, keys, gate, metric, limit):
    out = leader_cluster(rows, keys, ["score", "cand_id"], gate, metric=metric, group_limit=limit)
    return {(r.key, r.cand_id): r.cluster_id for r in out.collect()}


@pytest.mark.parametrize("listed,most", [(1 << 22, 3), (1500, 40)])
def test_rows_two_steps_from_all_others_take_few_rounds(spark, monkeypatch, listed, most):
    """Every row of the key is within two steps of nearly all others; copies count."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    x[650:] = x[:50]
    rows = [("k", n, float(n % 13), v.tolist()) for n, v in enumerate(x)]
    rows += [("l", n, float(n % 5), v.tolist()) for n, v in enumerate(rng.normal(size=(90, 8)))]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, score double, coords array<double>")
    maps = [(k, p) for k in "kl" for p in (list(range(8)), list(range(7, -1, -1)))]
    symmetry = pack_symmetry(["key"], spark.createDataFrame(maps, "key string, perm array<int>"))
    gate = Gate(0.75, dims=1)
    metric = BestRmsd("coords", 1, False, symmetry)
    want = clusters(df, ["key"], gate, metric, None)
    rounds = []
    plain = greedy.largest_group
    monkeypatch.setattr(greedy, "largest_group", lambda *a: (rounds.append(1), plain(*a))[1])
    monkeypatch.setattr(greedy, "LISTED", listed)
    assert clusters(df, ["key"], gate, metric, 60) == want
    assert len(set(want.values())) > 40
    # The first is asked for twice: whether there is a round at all comes first.
    assert len(rounds) <= most


ORDERS = {
    "group": ([[0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0]], [[0, 1], [4, 5]]),
    "one-way": ([[0, 1, 2, 3, 4, 5], [1, 2, 0, 3, 4, 5]], []),
    "one-way with a set": ([[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 0]], [[0, 2, 3]]),
}


def table(pos, x):
    return pa.table({"pos": pa.array(pos), "coords": pa.array(list(x.reshape(len(x), -1)))})


@pytest.mark.parametrize("dims", [1, 3])
@pytest.mark.parametrize("kind", sorted(ORDERS))
@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_products_tell_what_pairs_do(monkeypatch, dims, kind, same, strict):
    """Also for copies and for a limit that some pairs meet exactly."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(70, 6, dims)), 1)
    y = x if same else np.concatenate([x[:20], np.round(rng.normal(size=(30, 6, dims)), 1)])
    pos = rng.permutation(500)
    a, b = table(pos[:70], x), table(pos[:70] if same else pos[70:120], y)
    perms, swaps = ORDERS[kind]
    symmetry = pa.table({"_perms": pa.array([perms]), "_swaps": pa.array([swaps], pa.list_(pa.list_(pa.int64())))})
    first = best_rmsd(np.broadcast_to(x[:1], y.shape), y, Orders.of(symmetry, 6), False)
    gate = Gate(float(np.sort(first)[len(y) // 3]), strict, dims=dims)
    near = np.ones((70, len(y)), dtype=bool)
    metric = BestRmsd("coords", dims, False)
    measured = []
    plain = alignment.in_range
    monkeypatch.setattr(alignment, "in_range", lambda x, i, *a: (measured.append(len(i)), plain(x, i, *a))[1])
    got = metric.within(a, b, near.copy(), same, gate, symmetry)
    monkeypatch.setattr(alignment, "DENSE", 2.0)
    want = metric.within(a, b, near.copy(), same, gate, symmetry)
    assert (got == want).all() and want.any() and not want.all()
    if dims == 1:
        assert measured[0] * 4 <= measured[1]
