"""Blocks of pairs measured by matrix products, against every pair by itself."""

from itertools import permutations

import numpy as np
import pytest

from candidate_funnel.operators import alignment
from candidate_funnel.operators.alignment import Orders, aligned_rmsd, block_rmsd, moved_rmsd


def centred(x):
    return x - x.mean(axis=1, keepdims=True)


def every_pair(x, y, orders, align):
    i, j = np.divmod(np.arange(len(x) * len(y)), len(y))
    best = np.full(len(i), np.inf)
    for order in orders.each():
        a, b = x[i], y[j][:, order]
        one = moved_rmsd(centred(a), centred(b)) if align else np.sqrt(((a - b) ** 2).sum(axis=(1, 2)) / x.shape[1])
        best = np.minimum(best, one)
    return best.reshape(len(x), len(y))


def shapes(kind, n, atoms, rng):
    x = rng.normal(size=(n, atoms, 3))
    if kind == "near":
        x = x[:1] + rng.normal(0, 0.2, x.shape)
    elif kind == "copies":
        x = x[np.arange(n) % 3] + rng.normal(0, 1e-7, x.shape) * (np.arange(n) % 2)[:, None, None]
    elif kind == "flat":
        x[..., 2] = 0.0
    elif kind == "line":
        x[..., 1:] = 0.0
    elif kind == "mirrored":
        x = x[:1] * np.where(np.arange(n) % 2, -1.0, 1.0)[:, None, None] + rng.normal(0, 1e-3, x.shape)
    elif kind == "point":
        x[::2] = 1.0
    elif kind == "regular":
        corners = np.array([(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1), (0, 0, 0)], dtype=float)
        x = np.broadcast_to(corners, (n, 5, 3)) + rng.normal(0, 1e-9, (n, 5, 3))
    return x


@pytest.mark.parametrize("kind", ["random", "near", "copies", "flat", "line", "mirrored", "point", "regular"])
@pytest.mark.parametrize("align", [True, False])
@pytest.mark.parametrize("mapped", [True, False])
def test_block_keeps_every_pair_in_range(kind, align, mapped):
    rng = np.random.default_rng(len(kind))
    x = shapes(kind, 24, 5, rng)
    y = np.concatenate([shapes(kind, 20, 5, rng), x[:6]])
    perms = [[*p, 3, 4] for p in permutations(range(3))] if mapped else [range(5)]
    orders = Orders(np.array([list(p) for p in perms]))
    want = every_pair(x, y, orders, align)
    limit = float(np.quantile(want, 0.3)) + 1e-6
    near = np.ones(want.shape, dtype=bool)
    got = block_rmsd(x, y, orders, align, near, limit)
    assert (want <= limit).any()
    assert ((got <= limit) == (want <= limit)).all()
    assert got[want <= limit] == pytest.approx(want[want <= limit], abs=1e-9)
    # Pairs that are not asked for are never measured.
    near[:, ::2] = False
    assert np.isinf(block_rmsd(x, y, orders, align, near, limit)[:, ::2]).all()


def test_few_pairs_are_decomposed(monkeypatch):
    counted = []
    plain = np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda m, *rest, **named: (counted.append(len(m)), plain(m, *rest, **named))[1])
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 500, 22, 3))
    got = aligned_rmsd(a, b)
    assert sum(counted) <= 10
    assert got == pytest.approx(moved_rmsd(centred(a), centred(b)), abs=1e-12)


def test_pairs_out_of_range_are_spared(monkeypatch):
    counted = []
    plain = alignment.overlap_rmsd
    monkeypatch.setattr(
        alignment, "overlap_rmsd", lambda h, *rest: (counted.append(h.shape[2]), plain(h, *rest))[1]
    )
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1 / 8, (2, 100, 22, 3))
    block_rmsd(x, y, Orders(np.arange(22)[None]), True, np.ones((100, 100), dtype=bool), 0.2)
    assert sum(counted) < 2000


def test_pairs_in_a_fixed_frame_are_measured_once(monkeypatch):
    counted = []
    plain = alignment.rmsd
    monkeypatch.setattr(alignment, "rmsd", lambda a, b, i, *rest: (counted.append(len(i)), plain(a, b, i, *rest))[1])
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1 / 8, (2, 100, 64, 1))
    orders = Orders(np.array([np.arange(64), np.arange(64)[::-1], np.roll(np.arange(64), 32)]))
    near = np.ones((100, 100), dtype=bool)
    got = block_rmsd(x, y, orders, False, near, 0.155)
    assert 0 < (got <= 0.155).sum() <= sum(counted) <= 1.2 * (got <= 0.155).sum()
