"""Regions tell what the sequence would, and chains take few rounds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candidate_funnel.operators import greedy, neighbours
from candidate_funnel.operators.greedy import crowded_first, leader_cluster, settled
from candidate_funnel.operators.neighbours import Gate


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 60), st.integers(0, 10**6), st.floats(0.2, 3.0), st.booleans())
def test_regions_follow_the_sequence(n, seed, reach, weighted):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 20, n)
    near = np.abs(x[:, None] - x[None, :]) <= reach
    weight = rng.integers(1, 4, n) if weighted else np.ones(n, dtype=np.int64)
    want = crowded_first(near, weight)
    # A single region tells everything.
    assert (settled(near, weight, np.arange(n), np.ones(n, dtype=bool)) == want).all()
    # Regions between borders tell a part, and nothing else.
    for low in (0.0, 5.0, 10.0):
        inside = (x >= low - reach) & (x < low + 9 + reach)
        own = np.nonzero(inside)[0]
        core = (x[own] >= low) & (x[own] < low + 9)
        got = settled(near[np.ix_(own, own)], weight[own], own, core)
        for row, centre in zip(own, got, strict=True):
            assert centre == -1 or own[centre] == want[row]


def sequence(x, width):
    """Clusters of points on a line, following the definition on sorted points."""
    n = len(x)
    low, high = np.searchsorted(x, x - width - 1e-12), np.searchsorted(x, x + width + 1e-12)
    open_rows, centre = np.ones(n, dtype=bool), np.full(n, -1)
    count = high - low
    while open_rows.any():
        r = int(np.argmax(np.where(open_rows, count, -1)))
        members = np.arange(low[r], high[r])[open_rows[low[r] : high[r]]]
        centre[members] = r
        open_rows[members] = False
        for m in members:
            count[low[m] : high[m]] -= 1
    return centre


@pytest.mark.parametrize("n,most", [(5000, 12)])
def test_a_chain_takes_few_rounds(spark, monkeypatch, n, most):
    x = np.cumsum(np.full(n, 1.0)) * 0.9
    df = spark.createDataFrame([("a", i, float(i), [float(v)]) for i, v in enumerate(x)], "key string, cand_id bigint, score double, coords array<double>")
    rounds = []
    plain = greedy.largest_group
    monkeypatch.setattr(greedy, "largest_group", lambda *a: (rounds.append(1), plain(*a))[1])
    monkeypatch.setattr(neighbours, "REGION_ROWS", 2048)
    out = leader_cluster(df, ["key"], ["cand_id"], Gate(1.0), group_limit=100)
    got = {r.cand_id: r.cluster_id for r in out.collect()}
    assert [got[i] for i in range(n)] == sequence(x, 1.0).tolist()
    assert len(rounds) <= most
