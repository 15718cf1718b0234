"""Missing and broken values: a defined result on every path, and no hang."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candidate_funnel.operators import features, fingerprint, graph, select, skew
from candidate_funnel.operators.greedy import crowded_first, keep_first, leader_cluster
from candidate_funnel.operators.neighbours import Gate, pair_rmsd
from candidate_funnel.plans.funnel import run_funnel
from candidate_funnel.sources.spec import SourceSpec, load, restrict, restrict_long

POOL = "key string, cand_id bigint, score double, coords array<double>"
NAN = float("nan")


@pytest.fixture(scope="module")
def copies(spark):
    """Six pairs of near copies, a row with a NaN, and rows without a key."""
    rows = [("k", i, float(i), [float(i // 2), i * 1e-4, 0.0]) for i in range(12)]
    rows += [("k", 12, 12.0, [NAN, 0.0, 0.0]), ("k", 13, 13.0, None)]
    rows += [(None, 100 + i, 1.0, [0.0, 0.0, 0.0]) for i in range(20)]
    return spark.createDataFrame(rows, POOL)


@pytest.mark.parametrize("limit", [2048, 5])
def test_broken_rows_stay_apart(copies, limit):
    gate = Gate(0.01, dims=1)
    kept = keep_first(copies, ["key"], ["score"], gate, group_limit=limit)
    assert sorted(r.cand_id for r in kept.collect()) == [0, 2, 4, 6, 8, 10, 12, 13]
    led = {r.cand_id: r.cluster_id for r in leader_cluster(copies, ["key"], ["score"], gate, group_limit=limit).collect()}
    assert led == {**{i: i - i % 2 for i in range(12)}, 12: 12, 13: 13}
    pairs = pair_rmsd(copies, ["key"], max_dist=0.01, group_limit=limit).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(i, i + 1) for i in range(0, 12, 2)]


def test_a_centre_always_takes_itself():
    assert crowded_first(np.zeros((3, 3), dtype=bool), np.ones(3, dtype=np.int64)).tolist() == [0, 1, 2]


def test_ragged_vectors_are_an_error(spark):
    rows = [("k", i, 0.0, [0.0] * n) for i, n in enumerate((3, 9, 3))]
    with pytest.raises(Exception, match="differ in length"):
        pair_rmsd(spark.createDataFrame(rows, POOL), ["key"], max_dist=1.0).collect()


@pytest.mark.parametrize("bound", [10, None])
def test_null_keys_and_scores(spark, bound):
    rows = [("a", 1, 5.0), ("a", 2, None), (None, 3, 1.0), (None, 4, 1.0)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, score double")
    assert [r.cand_id for r in select.within(df, ["key"], "score", bound=bound).collect()] == [1]
    assert sorted(r.cand_id for r in select.relative(df, ["key"], "score", bound=bound).collect()) == [1, 2]
    top = select.top_k(df.where("key = 'a'"), ["key"], ["score"], 1).collect()
    assert [r.cand_id for r in top] == [1]
    reps = select.representatives(df.where("key = 'a'").withColumn("c", F.lit(1)), ["key"], "c", "score", bound=bound)
    assert [r.cand_id for r in reps.collect()] == [1]


def test_paths_agree_whatever_the_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else f"k{i % 3}", i, float(rng.integers(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, score double")
    want = None
    for hot, bound in ((1_000_000, 500), (1_000_000, None), (10, None)):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        got = sorted(
            (r.key, r.cand_id, round(r.weight, 12))
            for r in select.boltzmann(df, ["key"], "score", 1e4, bound=bound).collect()
        )
        want = want or got
        assert got == want and len(got) == sum(i % 7 != 0 for i in range(200))


def test_funnel_reports_what_broke(spark):
    ok = [0.0, 0.0, 0.0]
    rows = [
        ("fine", 1, 0, 1.0, ok), ("fine", 2, 0, None, ok), ("null score", 3, 0, None, ok),
        ("nan", 4, 0, 1.0, [NAN, 0.0, 0.0]), ("none", 5, 0, 1.0, None),
        ("ragged", 6, 0, 1.0, ok), ("ragged", 7, 0, 1.1, [0.0] * 9), (None, 8, 0, 1.0, ok),
    ]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, status int, score double, coords array<double>")
    for align in (False, True):
        done = run_funnel(df, ["key"], align=align)
        assert {r.key: r.outcome for r in done.outcomes().collect()} == {
            "fine": "ok", "null score": "bad_score", "nan": "bad_coords", "none": "bad_coords",
            "ragged": "ragged_coords", None: "null_key",
        }

    def null_energy(chosen):
        return chosen.withColumns({"score2": F.when(F.col("key") != "fine", F.col("score")), "converged": F.lit(True)})

    got = {r.key: r.outcome for r in run_funnel(df, ["key"], scorer=null_energy).outcomes().collect()}
    assert got["fine"] == "bad_score_second"


def test_atoms_past_the_end_are_reported(spark):
    kept = spark.createDataFrame([("g", i) for i in range(7)] + [("h", 0)], "key string, node_id int")
    rows = [("g", 1, 0, 1.0, [0.0] * 9), ("h", 2, 0, 1.0, [0.0] * 9)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, status int, score double, coords array<double>")
    out = {r.key: r.metric for r in graph.node_coords(df, ["key"], kept).collect()}
    assert out["g"] is None and len(out["h"]) == 3
    done = run_funnel(df, ["key"], cluster_metric=lambda x: graph.node_coords(x, ["key"], kept))
    assert {r.key: r.outcome for r in done.outcomes().collect()} == {"g": "coords_mismatch", "h": "ok"}


def test_each_metric_has_its_own_mappings(spark):
    """Clusters on one atom of two, copies on both: four candidates, one a mirror image."""
    rows = [("k", i, 0, 0.1 * i, c) for i, c in enumerate(([0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [5.0, 6.0]))]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, status int, score double, coords array<double>")
    swap = spark.createDataFrame([("k", [0, 1]), ("k", [1, 0])], "key string, perm array<int>")
    one = spark.createDataFrame([("k", [0])], "key string, perm array<int>")
    done = run_funnel(
        df, ["key"], dims=1, cluster_metric=lambda x: x.withColumn("metric", F.slice("coords", 1, 1)),
        cluster_mappings=one, dedup_mappings=swap, dedup_score=1e9, cluster_rmsd=0.1,
    )
    assert sorted(r.cand_id for r in done.clusters.collect()) == [0, 1, 3]
    assert sorted(r.cand_id for r in done.unique.collect()) == [0, 3]


def test_bounds_are_errors_not_cuts(spark):
    rows = [("k", i, 800) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, allowance int")
    with pytest.raises(Exception, match="above the cap"):
        select.cap_per_key(df, ["key"], "allowance", ["cand_id"]).collect()
    assert select.cap_per_key(df, ["key"], "allowance", ["cand_id"], cap=800).count() == 800
    packed = spark.createDataFrame([("k", [1.0, 2.0, 3.0])], "key string, features array<double>")
    with pytest.raises(Exception, match="3 values for 2 labels"):
        features.to_columns(packed, ["key"], 2, "lowest").collect()
    bits = spark.createDataFrame([("g", 3), ("g", 70)], "graph_id string, bit int")
    with pytest.raises(Exception, match="does not fit"):
        fingerprint.densify(bits, bits.select("graph_id"), 64).collect()


def test_feature_ids_are_compared(spark):
    vectors = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0])], "key string, cand_id bigint, features array<double>")
    members = spark.createDataFrame([("a", 1, 0.0), ("a", 3, 1.0)], "key string, cand_id bigint, score double")
    assert features.validate(vectors, members, ["key"]).first().outcome == "id_mismatch"
    assert features.aggregate(vectors, members, ["key"], "boltzmann").count() == 0


def test_null_tokens_are_foreign_in_both_forms(spark):
    rows = [(1, [1, 2]), (2, [1, None]), (3, [9]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, tokens array<int>")
    long = df.select("id", F.explode("tokens").alias("t"))
    want = [1, 4, 5]
    assert sorted(r.id for r in restrict(df, "tokens", {1, 2}).collect()) == want
    assert sorted(r.id for r in restrict_long(df, long, ["id"], "t", {1, 2}).collect()) == want


def test_a_spec_applies_its_filter(spark, tmp_path):
    (tmp_path / "f.csv").write_text("y,A,B\n1,CO,CC\n2,CF,CC\n3,CC,CC\n")
    spec = SourceSpec("f", "f.csv", "y", "max", ("A", "B"), allowed=frozenset({6, 8}))
    tokens = spark.createDataFrame([("CO", 6), ("CO", 8), ("CC", 6), ("CF", 6), ("CF", 9)], "key string, token int")
    got = load(spark, spec, str(tmp_path), tokens)
    assert got.columns == ["objective", "A", "B"]
    assert sorted(r.objective for r in got.collect()) == [1.0, 3.0]
    with pytest.raises(ValueError, match="tokens"):
        load(spark, spec, str(tmp_path))


def test_few_scans(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).selectExpr("id % 5 as key", "id as cand_id", "cast(id as double) as score").write.parquet(path)
    df = spark.read.parquet(path)

    def scans(frame):
        return frame._jdf.queryExecution().executedPlan().toString().count(path)

    assert scans(select.within(df, ["key"], "score")) <= 1
    assert scans(select.boltzmann(df, ["key"], "score")) <= 2
