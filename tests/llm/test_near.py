import random

import numpy as np
import pytest

from candidate_funnel.llm import odd_sketch as S
from candidate_funnel.llm.components import components


def brute(texts, size, hundredths):
    """Smallest id reachable over links, by comparing all pairs."""
    own = []
    for t in texts:
        w = (t or "").encode().lower().split()
        own.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if own[i] and own[j] and root[i] != root[j]:
                    both = len(own[i] & own[j])
                    if 100 * both >= hundredths * len(own[i] | own[j]):
                        root[i] = root[j] = min(root[i], root[j])
                        changed = True
    return root, [len(s) for s in own]


def group(rng, copies, words, edits):
    """Near copies of one text, each with some words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("size,similarity", [(3, 0.85), (5, 0.8)])
def test_large_group_in_tiles(spark, monkeypatch, size, similarity):
    monkeypatch.setattr(S, "BLOCK", 12)
    rng = random.Random(5)
    texts = group(rng, 90, 150, 9) + group(rng, 8, 60, 4) + [None, "", "one two", "One  TWO", "one"]
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(50)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in S.near_duplicates(df, shingle=size, similarity=similarity).collect()}
    root, sizes = brute(texts, size, round(similarity * 100))
    assert [rows[i]["component_id"] for i in range(len(texts))] == root
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(rows[i]["kept"] == (root[i] == i) for i in rows)


def test_estimate(spark):
    rng = np.random.default_rng(0)
    n_bands = S.bands(0.85)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    pairs, exact = [], []
    for keep in (400, 390, 370, 340):
        other = np.concatenate([base[:keep], rng.integers(0, 1 << 62, 400 - keep).astype(np.uint64)])
        _, sketches = S.signatures([np.sort(base), np.sort(other)], n_bands)
        pairs.append((sketches[0].view(np.int64).tolist(), sketches[1].view(np.int64).tolist()))
        exact.append(len(np.intersect1d(base, other)) / len(np.union1d(base, other)))
    df = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>")
    got = [r[0] for r in df.select(S.estimate(S.differing("a", "b"), n_bands * S.ROWS)).collect()]
    assert got == pytest.approx(exact, abs=0.13)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    pairs += [(500, k) for k in range(501, 560)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    root = {}
    for a, b in pairs:
        root.setdefault(a, a)
        root.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def test_one_document_of_a_group_stays(spark):
    rng = random.Random(7)
    texts = group(rng, 6, 120, 1) + ["alone here with five words or more"]
    df = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    root, _ = brute(texts, 5, 80)
    assert sorted(r["doc_id"] for r in S.deduplicate(df).collect()) == sorted({r + 10 for r in root})


def test_members_of_a_bucket_meet_without_its_named_node(spark):
    # One bucket of three like pairs: at most one pair holds the node it names.
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(3):
        own = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        other = np.concatenate([own[:380], rng.integers(0, 1 << 62, 20).astype(np.uint64)])
        _, sketches = S.signatures([np.sort(own), np.sort(other)], S.bands(0.8))
        rows += [(len(rows) + k, [77], sketches[k].view(np.int64).tolist()) for k in range(2)]
    df = spark.createDataFrame(rows, "node bigint, keys array<bigint>, sketch array<bigint>")
    got = {r["node"]: r["root"] for r in S.clusters(df, S.bands(0.8)).collect()}
    assert got == {1: 0, 3: 2, 5: 4}


def test_alike_has_the_limit_of_the_estimate(spark):
    samples = S.bands(0.8) * S.ROWS
    most = S.differing_most(S.LOOSE, samples)
    row = spark.range(1).select(*[S.estimate(S.F.lit(d), samples).alias(str(d)) for d in (most, most + 1)]).first()
    assert row[0] >= S.LOOSE > row[1]
