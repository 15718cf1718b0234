import numpy as np
import pytest

from candidate_funnel.functions.scalars import BOLTZMANN_EV_PER_K, EV_TO_KCAL
from candidate_funnel.operators import ensemble as ens
from candidate_funnel.operators import features as ft

LADDER = np.array([-41.3, -41.27, -41.21, -41.15, -41.02])


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(0xF00D)
    coords = rng.normal(size=(5, 9))
    rows = [("m", 4 - i, float(LADDER[i]), coords[i].tolist()) for i in (3, 1, 4, 0, 2)]
    rows.append(("lone", 7, -1.0, coords[0].tolist()))
    df = spark.createDataFrame(rows, "key string, cand_id bigint, score double, coords array<double>")
    return coords, df


@pytest.fixture(scope="module")
def totals(spark):
    return spark.createDataFrame([("m", 2, 3), ("lone", 0, 1)], "key string, charge int, multiplicity int")


def test_ensemble_is_ordered_single_precision(members, totals):
    coords, df = members
    out = ens.assemble(df, ["key"], totals=totals)
    rows = out.where("key = 'm'").orderBy("position").collect()
    assert [r.energy for r in rows] == LADDER.tolist()
    assert all(r.n == 5 and r.charge == 2 and r.multiplicity == 3 for r in rows)
    assert dict(out.dtypes)["coords"] == "array<float>"
    assert np.array(rows[0].coords) == pytest.approx(coords[0].astype(np.float32))
    assert ens.lowest(out).where("key = 'm'").first().cand_id == 4
    assert {r.key: r.n for r in ens.size_of(out, ["key"]).collect()} == {"m": 5, "lone": 1}


def test_packed_relative_energies(members):
    packed = ens.pack(ens.assemble(members[1], ["key"]), ["key"])
    rows = packed.select("key", ens.relative_energies("energies").alias("rel"), "coords").collect()
    rel = {r.key: r.rel for r in rows}
    assert rel["m"] == pytest.approx(((LADDER - LADDER[0]) * EV_TO_KCAL).tolist())
    assert rel["lone"] == [0.0]
    with pytest.raises(Exception, match="wider"):
        ens.pack(ens.assemble(members[1], ["key"]), ["key"], 3).collect()


def test_calculator_rows(spark, members, totals):
    coords, df = members
    nodes = spark.createDataFrame(
        [("m", i, n) for i, n in enumerate((16, 7, 1))], "key string, node_id int, number bigint"
    )
    rows = ens.as_atoms(ens.assemble(df, ["key"], totals=totals), nodes, ["key"]).orderBy("node_id").collect()
    assert [r.number for r in rows] == [16, 7, 1]
    assert np.array([r.xyz for r in rows]).ravel() == pytest.approx(coords[0].astype(np.float32))
    assert all(r.charge == 2 for r in rows)


def test_cap_on_the_ensemble(members):
    assert ens.assemble(members[1], ["key"], max_final=2).count() == 3


def aggregated(members, mode, **kw):
    df = members[1]
    vectors = df.select("key", "cand_id", "coords").withColumnRenamed("coords", "features")
    out = ft.vectors(ft.aggregate(vectors, df, ["key"], mode, **kw), ["key"])
    return {r.key: r.features for r in out.collect()}


def test_modes(members):
    coords, _ = members
    assert aggregated(members, "lowest")["m"] == pytest.approx(coords[0].tolist())
    w = np.exp(-(LADDER - LADDER[0]) / (BOLTZMANN_EV_PER_K * 298.15))
    assert aggregated(members, "boltzmann")["m"] == pytest.approx((w / w.sum() @ coords).tolist())
    stats = aggregated(members, "ensemble_stats")
    want = np.concatenate([coords.min(0), coords.max(0), coords.mean(0), coords.std(0)])
    assert stats["m"] == pytest.approx(want.tolist())
    assert stats["lone"][27:] == [0.0] * 9


def test_width_and_labels():
    assert ft.aggregated_width(9, "lowest") == 9
    assert ft.aggregated_width(9, "ensemble_stats") == 36
    labels = ft.feature_columns(2, "ensemble_stats")
    assert labels == ["min_0", "min_1", "max_0", "max_1", "mean_0", "mean_1", "std_0", "std_1"]
    for call in (ft.aggregated_width, ft.feature_columns):
        with pytest.raises(ValueError, match="no such way to pool"):
            call(3, "median")


def test_validation(spark, members):
    _, df = members
    with pytest.raises(ValueError, match="no such way to pool"):
        ft.aggregate(df, df, ["key"], "median")
    rows = [
        ("ragged", 0, [1.0]),
        ("ragged", 1, [1.0, 2.0]),
        ("short", 0, [1.0]),
        ("fine", 0, [1.0]),
        ("empty", 0, []),
        ("void", 0, None),
        ("extra", 0, [1.0]),
    ]
    vectors = spark.createDataFrame(rows, "key string, cand_id bigint, features array<double>")
    scored = [("ragged", 0), ("ragged", 1), ("short", 0), ("short", 1), ("fine", 0), ("empty", 0), ("void", 0), ("bare", 0)]
    pool = spark.createDataFrame([(k, i, 0.0) for k, i in scored], "key string, cand_id bigint, score double")
    got = {r.key: r.outcome for r in ft.validate(vectors, pool, ["key"]).collect()}
    assert got == {
        "ragged": "not_a_matrix",
        "short": "count_mismatch",
        "fine": "ok",
        "empty": "not_a_matrix",
        "void": "not_a_matrix",
        "extra": "count_mismatch",
        "bare": "count_mismatch",
    }
    for mode in ("lowest", "boltzmann", "ensemble_stats"):
        assert {r.key for r in ft.aggregate(vectors, pool, ["key"], mode).collect()} == {"fine"}
    with pytest.raises(Exception, match="not_a_matrix|count_mismatch"):
        ft.aggregate(vectors, pool, ["key"], "lowest", strict=True).collect()
