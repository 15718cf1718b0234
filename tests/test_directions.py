"""Principal directions: the moments' eigenvectors, safe for any vectors."""

import numpy as np
import pytest

from candidate_funnel.operators import neighbours
from candidate_funnel.operators.neighbours import Gate, directions, spaced, with_cells


def frame(spark, x, key="a"):
    rows = [(key, i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, cand_id bigint, coords array<double>").repartition(5)


def test_directions_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD_KEYS", 1)
    rng = np.random.default_rng(0)
    parts = {k: rng.normal(size=(80, 6)) * np.arange(1, 7) for k in ("a", "b")}
    df = frame(spark, parts["a"], "a").unionByName(frame(spark, parts["b"], "b"))
    got = {r.key: np.array(r["_axes"]) for r in directions(df, ["key"], "coords").collect()}
    for k, x in parts.items():
        want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, : neighbours.AXES].T
        assert np.abs((got[k] * want).sum(axis=1)) == pytest.approx([1.0] * neighbours.AXES, abs=1e-9)


@pytest.mark.parametrize("width", [1, 3, 300])
def test_cells_lose_no_neighbour(spark, width):
    """Unit vectors, which norms do not tell apart; longer ones than directions read; a single value."""
    rng = np.random.default_rng(width)
    x = rng.normal(size=(60, width)) * np.linspace(3, 0.1, width)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    gate = Gate(0.4 / np.sqrt(width))
    placed = with_cells(frame(spark, x), ["key"], gate, "coords", block_rows=8)
    cell = {r.cand_id: r["_cell"] for r in placed.collect()}
    assert len(cell) == 60 and all(len(c) == gate.lanes for c in cell.values())
    near = np.linalg.norm(x[:, None] - x[None], axis=2) / np.sqrt(width) <= gate.rmsd
    for i, j in zip(*np.nonzero(near)):
        assert max(abs(a - b) for a, b in zip(cell[i], cell[j])) <= 1
    if width == 3:
        assert len({tuple(c) for c in cell.values()}) > 1
    assert spaced(x).shape[1] == min(width, 256)
