"""Greedy selection against the sequential definition, on every path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candidate_funnel.operators.greedy import keep_first, leader_cluster
from candidate_funnel.operators.neighbours import Gate, pair_rmsd, structures

SCHEMA = "key string, cand_id bigint, score double, coords array<double>"


def make_pool(seed, sizes, dims=4, spread=1.0, copies=0, crowd=0):
    """Random candidates; some exact copies and some near ones in key 0."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        points = rng.normal(0, spread, (n, dims))
        if k == 0 and copies:
            points[:copies] = points[0]
        if k == 0 and crowd:
            points[copies : copies + crowd] = points[copies] + rng.normal(0, 1e-3, (crowd, dims))
        scores = np.round(rng.uniform(0, 5, n), 1)
        for p, s in zip(points, scores, strict=True):
            rows.append((f"k{k}", len(rows), float(s), [float(x) for x in p]))
    order = rng.permutation(len(rows))
    return pd.DataFrame([rows[i] for i in order], columns=["key", "cand_id", "score", "coords"])


def near_matrix(group, gate):
    x = np.array(group["coords"].tolist())
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2) / (x.shape[1] / gate.dims))
    near = dist < gate.rmsd if gate.strict else dist <= gate.rmsd
    if gate.score is not None:
        s = group["score"].to_numpy()
        near &= np.abs(s[:, None] - s[None]) < gate.score
    return near


def expected_kept(pool, gate):
    kept = set()
    for _, group in pool.sort_values(["score", "cand_id"]).groupby("key"):
        near, taken = near_matrix(group, gate), []
        for i in range(len(group)):
            if not any(near[i, j] for j in taken):
                taken.append(i)
        kept |= set(group["cand_id"].iloc[taken])
    return kept


def expected_clusters(pool, gate):
    centre = {}
    for _, group in pool.sort_values(["score", "cand_id"]).groupby("key"):
        near, ids = near_matrix(group, gate), group["cand_id"].to_numpy()
        alive = set(range(len(ids)))
        while alive:
            best = max(alive, key=lambda i: (sum(near[i, j] for j in alive), -i))
            for j in [j for j in alive if near[best, j]]:
                centre[ids[j]] = ids[best]
                alive.discard(j)
    return centre


GATES = [
    Gate(0.6),
    Gate(0.6, strict=True, score=0.7),
    Gate(0.9, strict=True, dims=2),
]


@pytest.mark.parametrize("gate", GATES)
@pytest.mark.parametrize("limit", [2048, 5])
def test_keep_first_is_sequential(spark, gate, limit):
    pool = make_pool(3, [30, 9, 1, 14], copies=7, crowd=7)
    df = spark.createDataFrame(pool, SCHEMA)
    out = keep_first(df, ["key"], ["score", "cand_id"], gate, score="score", group_limit=limit)
    assert out.columns == df.columns
    assert {r.cand_id for r in out.collect()} == expected_kept(pool, gate)


@pytest.mark.parametrize("seed,limit", [(1, 2048), (2, 2048), (1, 10)])
def test_leader_cluster_is_sequential(spark, seed, limit):
    pool = make_pool(seed, [30, 9, 1, 14], copies=7, crowd=7)
    df = spark.createDataFrame(pool, SCHEMA)
    out = leader_cluster(df, ["key"], ["score", "cand_id"], Gate(0.6), group_limit=limit)
    assert {r.cand_id: r.cluster_id for r in out.collect()} == expected_clusters(pool, Gate(0.6))


@pytest.mark.parametrize("limit", [2048, 10])
def test_listed_pairs_give_the_same(spark, limit):
    pool = make_pool(5, [30, 9, 1, 14], crowd=8)
    df = spark.createDataFrame(pool, SCHEMA)
    pairs = pair_rmsd(df, ["key"], max_dist=0.8)
    order = ["score", "cand_id"]
    gate = Gate(0.6, strict=True, score=0.7)
    kept = keep_first(df, ["key"], order, gate, score="score", pairs=pairs, group_limit=limit)
    assert {r.cand_id for r in kept.collect()} == expected_kept(pool, gate)
    led = leader_cluster(df, ["key"], order, Gate(0.6), pairs=pairs, group_limit=limit)
    assert {r.cand_id: r.cluster_id for r in led.collect()} == expected_clusters(pool, Gate(0.6))


@pytest.mark.parametrize("limit", [2048, 10])
def test_weights_stand_for_copies(spark, limit):
    pool = make_pool(8, [30], copies=9)
    df = spark.createDataFrame(pool, SCHEMA)
    best = df.groupBy("key", "coords").agg(
        F.min(F.struct("score", "cand_id")).alias("b"), F.count("*").alias("n")
    )
    points = best.select("key", "coords", "n", "b.score", "b.cand_id")
    led = leader_cluster(
        points, ["key"], ["score", "cand_id"], Gate(0.6), weight="n", group_limit=limit
    )
    want = expected_clusters(pool, Gate(0.6))
    assert all(want[r.cand_id] == r.cluster_id for r in led.collect())


def test_gap_at_the_gate_is_kept_and_chains_do_not_collapse(spark):
    rows = [("k", i, 0.1 * i, [0.5 * i]) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    gate = Gate(0.5, strict=True)
    assert keep_first(df, ["key"], ["score"], gate).count() == 5
    wider = Gate(0.75, strict=True)
    kept = keep_first(df, ["key"], ["score"], wider).orderBy("cand_id").collect()
    assert [r.cand_id for r in kept] == [0, 2, 4]


@pytest.mark.parametrize("limit", [2048, 10])
def test_pairs_are_lossless(spark, limit):
    pool = make_pool(11, [70, 6], spread=0.7, crowd=10)
    df = spark.createDataFrame(pool, SCHEMA)
    out = pair_rmsd(df, ["key"], max_dist=0.5, group_limit=limit).collect()
    want = {}
    for key, group in pool.groupby("key"):
        near = near_matrix(group, Gate(0.5))
        ids = group["cand_id"].to_numpy()
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            want[key, min(ids[i], ids[j]), max(ids[i], ids[j])] = True
    assert len(out) == len(want)
    assert {(r.key, r.a, r.b) for r in out} == set(want)


def test_structures_collapse_copies(spark):
    df = spark.createDataFrame(make_pool(2, [40], copies=10), SCHEMA)
    found = structures(df, ["key"], "cand_id")
    assert found.count() == 31
    assert found.agg(F.sum("n")).first()[0] == 40


def test_large_crowd_sends_no_pairs(spark):
    """A key of near copies is settled without one row per pair."""
    rng = np.random.default_rng(4)
    rows = [
        ("hot", i, float(i % 7), [float(x) for x in 1 + rng.normal(0, 1e-4, 3)]) for i in range(1500)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = keep_first(df, ["key"], ["score", "cand_id"], Gate(0.1, strict=True), group_limit=400)
    assert [r.cand_id for r in out.collect()] == [0]
    led = leader_cluster(df, ["key"], ["score", "cand_id"], Gate(0.1), group_limit=400)
    assert led.select("cluster_id").distinct().count() == 1
