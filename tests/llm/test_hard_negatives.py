"""Packed products are exact; mining is the definition, whatever the tiles."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candidate_funnel.llm import hard_negatives as hn

from .conftest import VECTORS


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 9), st.integers(0, 62), st.integers(0, 20), st.integers(1, 6), st.randoms(use_true_random=False))
def test_packing_is_exact(dims, bits, n_rows, n_anchors, rnd):
    bound = (1 << bits) - 1
    pack = hn.Packing(dims, bound)

    def rows(n):
        values = [[rnd.choice([-bound, bound, rnd.randint(-bound, bound)]) for _ in range(max(dims, 1))] for _ in range(n)]
        return np.array(values, dtype=np.int64).reshape(n, max(dims, 1))

    a, c = rows(n_anchors), rows(n_rows)
    exact = a.astype(object) @ c.astype(object).T if n_rows else np.zeros((n_anchors, 0), dtype=object)
    got = pack.scores(pack.biased(a), pack.biased(c))
    assert (got == np.clip(exact, hn.LEAST, hn.MOST)).all()


def test_usual_vectors_share_a_double():
    assert hn.Packing(64, 160).fields == 2 and hn.Packing(64, 160).exact_doubles
    assert not hn.Packing(3, 1 << 40).exact_doubles


def brute(rows, anchor, n_pos=5, n_neg=3):
    taken = set()
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.add((hn.NO_ID if i is None else i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in taken:
        if a[0] == hn.NO_ID or not anchor(a[0]):
            continue
        best = lambda rs: sorted((-dot(a[2], r[2]), r[0]) for r in rs)
        unlike = best(r for r in taken if r[1] != a[1])
        for p, pid in best(r for r in taken if r[1] == a[1] and r != a)[:n_pos]:
            inside = [(q, i) for q, i in unlike if 50 * -p <= 100 * -q <= 95 * -p]
            out += [(a[0], pid, k, i, -p, -q) for k, (q, i) in enumerate(inside[:n_neg], 1)]
    null = lambda i: None if i == hn.NO_ID else i
    return sorted(((a, null(b), k, null(c), p, q) for a, b, k, c, p, q in out), key=str)


def mined(spark, rows, every=50, **kinds):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id bigint, label int, embedding array<float>, rank int, _v string")
    return sorted(map(tuple, hn.mine(df, F.col("_id") % every == 0).collect()), key=str)


def test_odd_rows(spark):
    assert mined(spark, VECTORS) == brute(VECTORS, lambda i: i % 50 == 0)
    assert mined(spark, VECTORS * 3) == brute(VECTORS, lambda i: i % 50 == 0)
    assert any(r[3] is None for r in mined(spark, VECTORS))


@pytest.mark.parametrize("block,stripe", [(16_384, 16_384), (3, 20)])
def test_tiles(spark, monkeypatch, block, stripe):
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(hn, "STRIPE_ROWS", stripe)
    rng = np.random.default_rng(3)
    # A third of the rows has one label; coarse values make ties.
    rows = [
        (i, int(rng.choice([0, 0, 1, 2, 3])), [float(x) for x in np.round(rng.normal(0.2, 0.4, 4) * 4) / 4])
        for i in range(400)
    ]
    assert mined(spark, rows, 20) == brute(rows, lambda i: i % 20 == 0)


def test_wide_values(spark):
    rows = [(0, 0, [3e5, 1.0]), (1, 0, [2.9e5, -7.0]), (2, 1, [2.5e5, 1.0]), (3, 1, [-1e30, 1.0]), (4, 1, [1e4, 0.0]), (5, 0, [1e30, 0.0])]
    got = mined(spark, rows)
    exact = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    # The largest components stop at the ends of long, as does their product.
    assert (0, 5) not in {(r[0], r[1]) for r in got if r[4] < hn.MOST}
    assert (0, 1, 1, 2, exact(rows[0][2], rows[1][2]), exact(rows[0][2], rows[2][2])) in got
