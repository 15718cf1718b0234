import math

import pytest
from pyspark.sql import functions as F

from candidate_funnel.functions.scalars import BOLTZMANN_EV_PER_K, EV_TO_KCAL, budget
from candidate_funnel.operators import pool, select
from candidate_funnel.operators.score import apply_scorer

LADDER = [-41.3, -41.27, -41.21, -41.15, -41.02]


@pytest.fixture(scope="module")
def ladder(spark):
    rows = [("m", i, e) for i, e in enumerate(LADDER)] + [("lone", 0, -3.5)]
    return spark.createDataFrame(rows, "key string, cand_id bigint, score double")


@pytest.mark.parametrize("bound", [None, 20])
def test_relative(ladder, bound):
    out = select.relative(ladder, ["key"], "score", bound=bound).where("key = 'm'").orderBy("cand_id")
    rel = [r.rel for r in out.collect()]
    assert rel[0] == 0.0
    assert rel == pytest.approx([(e - LADDER[0]) * EV_TO_KCAL for e in LADDER])
    assert rel == pytest.approx([0, 0.691816, 2.075449, 3.459082, 6.456953], abs=1e-6)


@pytest.mark.parametrize("bound", [None, 20])
def test_boltzmann(ladder, bound):
    out = select.boltzmann(ladder, ["key"], "score", bound=bound)
    weights = [r.weight for r in out.where("key = 'm'").orderBy("cand_id").collect()]
    assert weights == pytest.approx(
        [0.743971753, 0.231446960, 0.022399666, 0.002167862, 0.000013759], abs=1e-9
    )
    assert sum(weights) == pytest.approx(1.0, abs=1e-12)
    assert weights == sorted(weights, reverse=True)
    assert out.where("key = 'lone'").first().weight == 1.0
    shifted = select.boltzmann(
        ladder.withColumn("score", F.col("score") + 500.0), ["key"], "score", bound=bound
    )
    again = [r.weight for r in shifted.where("key = 'm'").orderBy("cand_id").collect()]
    assert again == pytest.approx(weights)
    cold = select.boltzmann(ladder, ["key"], "score", 1.0, bound=bound)
    frozen = [r.weight for r in cold.where("key = 'm'").orderBy("cand_id").collect()]
    assert frozen == pytest.approx([1, 0, 0, 0, 0], abs=1e-9)


def test_temperature_must_be_positive(ladder):
    with pytest.raises(ValueError):
        select.boltzmann(ladder, ["key"], "score", 0.0)


@pytest.mark.parametrize("bound", [None, 20])
def test_window_is_inclusive(spark, bound):
    df = spark.createDataFrame([("k", 1.0), ("k", 11.0), ("k", 11.5)], "key string, score double")
    assert select.within(df, ["key"], "score", 10.0, bound=bound).count() == 2


def test_rank_of_a_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        (F.col("id") % 4).cast("double").alias("score"),
        F.col("id").alias("cand_id"),
    )
    plain = select.rank(df, ["key"], ["score", "cand_id"])
    sliced = select.rank(df, ["key"], ["score", "cand_id"], hot_rows=100)
    assert sliced.count() == 5000
    cols = ["key", "cand_id", "rank"]
    assert sliced.select(cols).exceptAll(plain.select(cols)).count() == 0


def test_top_k_trims_before_the_shuffle(ladder):
    best = select.top_k(ladder, ["key"], ["score", "cand_id"], 2, "place")
    assert best.count() == 3
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_cap_per_key(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("key"), "id", F.lit(7).alias("budget"))
    kept = select.cap_per_key(df, ["key"], "budget", ["id"], cap=500)
    assert [r["count"] for r in kept.groupBy("key").count().collect()] == [7, 7]
    with pytest.raises(Exception, match="allowance 7 is above the cap 3"):
        select.cap_per_key(df, ["key"], "budget", ["id"], cap=3).collect()


@pytest.mark.parametrize("bound", [None, 20])
def test_representatives_take_the_lowest(spark, bound):
    rows = [("k", 5, 1.0, 9), ("k", 4, 1.0, 9), ("k", 1, 2.0, 9), ("k", 8, 0.5, 8)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, score double, cluster_id bigint")
    best = select.representatives(df, ["key"], "cluster_id", "score", bound=bound)
    assert {r.cand_id for r in best.collect()} == {4, 8}


def test_converged_on_status_and_flag(spark):
    df = spark.createDataFrame([(0, True), (1, True), (0, False)], "status int, ok boolean")
    assert select.converged(df).count() == 2
    assert select.converged(df, "ok").count() == 2


def test_budget(spark):
    df = spark.createDataFrame([(0,), (3,), (9,), (40,)], "n int")
    assert [r[0] for r in df.select(budget("n")).collect()] == [50, 200, 500, 500]


def test_expand_is_reproducible(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0)], "key string, budget int")
    first = pool.expand(df, ["key"], "budget").collect()
    assert [r.cand_id for r in first] == [0, 1, 2]
    assert first == pool.expand(df, ["key"], "budget").collect()
    assert len({r.seed for r in first}) == 3


def test_route_by_items_that_are_the_keys(spark):
    items = spark.createDataFrame([(1,), (1,), (2,), (3,)], "key int")
    known = spark.createDataFrame([(1,), (3,)], "key int")
    routes = pool.route(items, ["key"], "key", known)
    assert {r.key: r.route for r in routes.collect()} == {1: "primary", 2: "fallback", 3: "primary"}


def test_route_is_all_or_nothing(spark):
    items = spark.createDataFrame(
        [("a", 6), ("a", 8), ("b", 6), ("b", 5), ("c", 5)], "key string, element int"
    )
    known = spark.createDataFrame([(6,), (8,)], "element int")
    routes = pool.route(items, ["key"], "element", known)
    assert {r.key: r.route for r in routes.collect()} == {
        "a": "primary",
        "b": "fallback",
        "c": "fallback",
    }
    one = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "key string, score double")
    two = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "key string, score double")
    chosen = pool.apply_route(one, two, routes, ["key"])
    assert {r.key: r.score for r in chosen.collect()} == {"a": 1.0, "b": 2.0}


def test_zip_strict(spark):
    df = spark.createDataFrame([("a", [1, 2], [0.5, 1.5])], "key string, ids array<int>, e array<double>")
    assert [tuple(r) for r in pool.zip_strict(df, "ids", "e").collect()] == [
        ("a", 0, 1, 0.5),
        ("a", 1, 2, 1.5),
    ]
    uneven = spark.createDataFrame([("a", [1], [0.5, 1.5])], df.schema)
    with pytest.raises(Exception, match="cannot pair 1 values with 2"):
        pool.zip_strict(uneven, "ids", "e").collect()


def test_scorer_opens_one_model_per_task(spark):
    def open_model():
        state = {"opened": 0}
        state["opened"] += 1

        def run(batch, steps):
            return batch.assign(score2=batch["score"] * 2 + steps, opened=state["opened"])

        return run

    df = spark.range(40).select("id", F.col("id").cast("double").alias("score"))
    out = apply_scorer(
        df, ["id"], open_model, "id bigint, score double, score2 double, opened int", tasks=4, steps=5
    ).collect()
    assert len(out) == 40
    assert all(r.score2 == 2 * r.score + 5 and r.opened == 1 for r in out)


def test_constants():
    assert math.isclose(BOLTZMANN_EV_PER_K * 298.15 * EV_TO_KCAL, 0.592484, rel_tol=1e-5)
