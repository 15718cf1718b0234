import numpy as np
import pytest
from pyspark.sql import functions as F

from candidate_funnel.operators.graph import node_coords
from candidate_funnel.operators.outcomes import funnel_report, outcomes
from candidate_funnel.operators.score import apply_scorer
from candidate_funnel.plans.funnel import guarded_metric, run_funnel

SCHEMA = "key string, cand_id bigint, status int, score double, coords array<double>"


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 60), ("b", 20), ("one", 1), ("unconverged", 4)):
        shapes = rng.normal(size=(6, 12))
        for i in range(n):
            x = shapes[i % 6] + rng.normal(0, 0.02, 12)
            status = 1 if key == "unconverged" or (i % 9 == 4 and n > 1) else 0
            rows.append((key, len(rows), status, float(i % 6) + rng.uniform(0, 0.001), x.tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_and_report(spark, pool):
    done = run_funnel(pool, ["key"], max_final=4)
    report = {r.key: r for r in done.report().collect()}
    assert (report["a"].embedded, report["a"].clusters, report["a"].selected) == (60, 6, 6)
    assert report["a"].unique == 6
    assert report["a"].span == pytest.approx(5 * 23.06, abs=0.1)
    assert (report["one"].in_window, report["one"].clusters, report["one"].unique) == (1, 1, 1)
    assert report["unconverged"].in_window == 0
    keyed = pool.select("key").distinct().union(spark.createDataFrame([("none",)], "key string"))
    got = {r.key: r.outcome for r in done.outcomes(keyed).collect()}
    assert got == {
        "a": "ok",
        "b": "ok",
        "one": "ok",
        "unconverged": "none_converged_first",
        "none": "no_candidate",
    }
    sizes = {r.key: r.n for r in done.ensemble.collect()}
    assert sizes == {"a": 4, "b": 4, "one": 1}
    with pytest.raises(Exception, match="none_converged_first: unconverged"):
        done.outcomes(strict=True).collect()


def test_alignment_finds_turned_copies(spark, pool):
    def turned(x, i):
        t = 0.7 * i
        r = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
        return (np.reshape(x, (-1, 3)) @ r + i).ravel().tolist()

    rows = [(r.key, r.cand_id, r.status, r.score, turned(r.coords, r.cand_id)) for r in pool.collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    report = {r.key: r for r in run_funnel(df, ["key"], align=True).report().collect()}
    assert report["a"].clusters == 6 and report["a"].unique == 6
    fixed = {r.key: r for r in run_funnel(df, ["key"]).report().collect()}
    assert fixed["a"].clusters > 20


def test_metric_on_some_atoms(spark, pool):
    """Atoms left out of the metric do not count; all stay in the ensemble."""
    noise = F.transform("coords", lambda x, i: F.when(i >= 9, x + F.col("cand_id") * 3.0).otherwise(x))
    noisy = pool.withColumn("coords", noise)
    heavy = pool.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, range(3)))).alias("node_id"))

    def metric(df):
        return node_coords(df, ["key"], heavy)

    done = run_funnel(noisy, ["key"], cluster_metric=metric, dedup_metric=metric)
    report = {r.key: r for r in done.report().collect()}
    assert report["a"].clusters == 6 and report["a"].unique == 6
    assert all(len(r.coords) == 12 for r in done.ensemble.collect())
    assert run_funnel(noisy, ["key"]).report().where("key = 'a'").first().clusters > 20


def test_guard_switches_the_metric(spark):
    """Two keys of the same star graph; only one reaches the cap."""
    nodes = spark.createDataFrame(
        [(g, i, "H" if i == 5 else "C") for g in ("few", "many") for i in range(6)],
        "graph_id string, node_id int, label string",
    )
    edges = spark.createDataFrame(
        [(g, a, b) for g in ("few", "many") for a, b in ((0, 1), (1, 2), (2, 0), (0, 3), (1, 4), (2, 5))],
        "graph_id string, src int, dst int",
    )
    mappings = spark.createDataFrame([("few", 0)] + [("many", i) for i in range(3)], "graph_id string, m int")
    metric, guard = guarded_metric(nodes, edges, mappings, heavy=F.col("label") == "C", cap=3)
    assert {r.graph_id: r.use_core for r in guard.collect()} == {"few": False, "many": True}
    rows = [(g, i, 0, 0.0, [float(x) for x in range(18)]) for i, g in enumerate(("few", "many"))]
    df = metric(spark.createDataFrame(rows, SCHEMA))
    assert {r.key: len(r.metric) // 3 for r in df.collect()} == {"few": 5, "many": 3}


def test_scorer_replaces_coordinates(pool):
    def open_model():
        def run(batch, steps):
            return batch.assign(
                score2=batch["score"] * 0.0 + batch["cand_id"] * 1e-6,
                converged=batch["key"] != "b",
                coords=[[0.0] * 12 for _ in range(len(batch))],
            )

        return run

    def scorer(df):
        return apply_scorer(df, ["key", "cand_id"], open_model, SCHEMA + ", score2 double, converged boolean", steps=9)

    done = run_funnel(pool, ["key"], scorer)
    report = {r.key: r for r in done.report().collect()}
    assert (report["a"].relaxed, report["a"].unique) == (6, 1)
    got = {r.key: r.outcome for r in done.outcomes().collect()}
    assert got["b"] == "none_converged_second"


def test_large_and_small_keys_agree(pool, monkeypatch):
    from candidate_funnel.operators import skew

    want = {(r.key, r.cand_id) for r in run_funnel(pool, ["key"]).ensemble.collect()}
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    got = {(r.key, r.cand_id) for r in run_funnel(pool, ["key"], bound=10**9).ensemble.collect()}
    assert got == want


def test_bad_scores_are_reported(spark):
    rows = [("nan", 1, 0, float("nan"), [0.0] * 3), ("good", 2, 0, 1.0, [0.0] * 3), ("good", 3, 0, float("nan"), [1.0] * 3)]
    done = run_funnel(spark.createDataFrame(rows, SCHEMA), ["key"])
    assert {r.key: r.outcome for r in done.outcomes().collect()} == {"nan": "bad_score", "good": "ok"}
    assert [r.cand_id for r in done.ensemble.collect()] == [2]


def test_report_and_outcome_helpers(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 0.5)], "key string, rel double")
    b = a.where("rel > 0.7")
    rows = {r.key: r for r in funnel_report({"all": a, "some": b}, ["key"], ("some", "rel")).collect()}
    assert (rows["x"]["all"], rows["x"]["some"], rows["x"].span) == (2, 2, 2.0)
    assert (rows["y"]["all"], rows["y"]["some"], rows["y"].span) == (1, 0, None)
    keyed = a.select("key").distinct()
    got = {r.key: r.outcome for r in outcomes(keyed, {"gone": b}, ["key"]).collect()}
    assert got == {"x": "ok", "y": "gone"}
