from itertools import permutations

import numpy as np
import pytest

from candidate_funnel.operators.alignment import aligned_rmsd, pair_best_rmsd

SCHEMA = "key string, cand_id bigint, coords array<double>"


def rotation(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


def brute(a, b, steps=12):
    """Largest overlap over rotations from the quaternion matrix (Horn 1987)."""
    a, b = a - a.mean(0), b - b.mean(0)
    m = b.T @ a
    k = np.array(
        [
            [m[0, 0] + m[1, 1] + m[2, 2], m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]],
            [0, m[0, 0] - m[1, 1] - m[2, 2], m[0, 1] + m[1, 0], m[2, 0] + m[0, 2]],
            [0, 0, -m[0, 0] + m[1, 1] - m[2, 2], m[1, 2] + m[2, 1]],
            [0, 0, 0, -m[0, 0] - m[1, 1] + m[2, 2]],
        ]
    )
    k = k + k.T - np.diag(np.diag(k))
    top = np.linalg.eigvalsh(k)[-1]
    return np.sqrt(max((a**2).sum() + (b**2).sum() - 2 * top, 0) / len(a))


def test_aligned_rmsd_matches_the_quaternion_form():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 6, 3)), rng.normal(size=(50, 6, 3))
    assert aligned_rmsd(a, b) == pytest.approx([brute(x, y) for x, y in zip(a, b, strict=True)])


def test_moved_copy_is_zero_and_mirror_image_is_not():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(1, 5, 3))
    assert aligned_rmsd(a, a @ rotation(rng) + 4.0)[0] == pytest.approx(0, abs=1e-10)
    assert aligned_rmsd(a, a * [1, 1, -1])[0] > 0.1


def make(spark, n=24, atoms=4):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3, atoms, 3))
    rows = []
    for i in range(n):
        x = base[i % 3] + rng.normal(0, 0.15, (atoms, 3))
        x = (x @ rotation(rng) + rng.normal(size=3))[rng.permutation(atoms)]
        rows.append(("big" if i < 18 else "tiny", i, x.ravel().tolist()))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("limit", [2048, 8])
@pytest.mark.parametrize("align", [True, False])
@pytest.mark.parametrize("mapped", [True, False])
def test_best_rmsd_is_lossless(spark, limit, align, mapped):
    rows, df = make(spark)
    perms = list(permutations(range(4))) if mapped else [(0, 1, 2, 3)]
    maps = None
    if mapped:
        maps = spark.createDataFrame(
            [(k, i, list(p)) for k in ("big", "tiny") for i, p in enumerate(perms)],
            "key string, mapping_id int, perm array<int>",
        )
    limit_dist = 0.5 if align else 1.4
    out = pair_best_rmsd(df, ["key"], limit_dist, maps, align, group_limit=limit)
    got = {(r.a, r.b): r.dist for r in out.collect()}
    want = {}
    for ka, a, x in rows:
        for kb, b, y in rows:
            if ka == kb and a < b:
                u, v = np.reshape(x, (4, 3)), np.reshape(y, (4, 3))
                each = (
                    brute(u, v[list(p)]) if align else np.sqrt(((u - v[list(p)]) ** 2).sum() / 4)
                    for p in perms
                )
                best = min(each)
                if best <= limit_dist:
                    want[a, b] = best
    assert want and got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


def test_alignment_needs_three_values_per_atom(spark):
    with pytest.raises(ValueError):
        pair_best_rmsd(make(spark)[1], ["key"], 0.5, dims=2)
