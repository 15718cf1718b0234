"""Every registered query against its SQL on the smallest tables."""

import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    yield con
    con.close()


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name not in entry.oracle_sql():
        return
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    assert len(rows) == len(want)
    for got, ref in zip(canonical(rows, df.columns), canonical(want, names), strict=True):
        assert got == pytest.approx(ref, abs=1e-7)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_outcomes_of_mappings_do_not_rest_on_convergence(spark, duck, tmp_path):
    """Ids that stand for candidates which did not converge, in either stage."""
    ids = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id * 77 as vec_id", "embedding", "label")
    ids.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = entry.queries()["outcome_mappings"](spark, str(tmp_path)).collect()
    want = duck.execute(entry.oracle_sql()["outcome_mappings"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)
