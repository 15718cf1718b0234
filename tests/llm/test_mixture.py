import random

import pytest

from candidate_funnel.llm import mixture


def reshared(sizes, weights, share=1.5, most=2):
    """Targets by handing the excess out again until none is left."""
    open_ = set(range(len(sizes)))
    target = [0.0] * len(sizes)
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        give = {i: left * weights[i] / total for i in open_}
        over = {i for i in open_ if give[i] >= most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = give[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 1000, 90_000]) for _ in range(11)]
    rows = [(f"s{i:02}", s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "_source string, source_size bigint")
    got = {r["_source"]: r["target"] for r in mixture.targets(df).collect()}
    want = reshared(sizes, [(3, 1, 2)[i % 3] for i in range(11)])
    assert [got[f"s{i:02}"] for i in range(11)] == pytest.approx(want)


def test_budgets_are_met_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 16)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    rows = mixture.mix(docs).toPandas()
    again = mixture.mix(docs.repartition(5)).toPandas()
    assert rows.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    full = rows.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in full.groupby("source"):
        assert g["taken"].sum() == round(g["target"].iloc[0])
    assert (rows["taken"] <= 2 * rows["size"]).all()
    assert rows["taken"].sum() == pytest.approx(1.5 * rows["size"].sum(), abs=len(full["source"].unique()))


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixture.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_materialised_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixture.mix(docs).collect()}
    seen = {}
    for r in mixture.materialise(docs).collect():
        assert len(r["text"].encode().split()) == r["taken"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["taken"]
    assert seen == {k: v for k, v in taken.items() if v}


def test_materialised_names_that_clash(spark):
    rows = [(1, "a", "one two", "x", "y"), (2, "a", "three", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, Size string, mix_taken string")
    out = mixture.materialise(docs)
    assert out.columns == [*docs.columns, *[f"mix_mix_{n}" for n in ("epoch", "size", "target", "taken")]]
    assert all(r["mix_mix_taken"] == len(r["text"].split()) and r["Size"] == "x" for r in out.collect())
