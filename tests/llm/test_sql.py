"""Queries with SQL give the SQL's rows, on odd tables too."""

import duckdb
import pytest

from candidate_funnel.llm.oracles import ORACLES
from candidate_funnel.llm.queries import QUERIES


def both(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'' if folder.startswith('/root') else '/*.parquet'}')")
    theirs = con.execute(ORACLES[name])
    names = [c[0] for c in theirs.description]
    ours = QUERIES[name](spark, folder)
    assert sorted(names) == sorted(ours.columns)
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(tuple, ours.select(*names).collect()), key=key), sorted(theirs.fetchall(), key=key)


@pytest.mark.parametrize("name", list(ORACLES))
def test_small_table(spark, name):
    ours, theirs = both(spark, name, "/root/testdata/sf0.001")
    assert ours == theirs


def test_chat_on_odd_rows(spark, odd_dir):
    ours, theirs = both(spark, "op2_chat_format", odd_dir)
    assert ours == theirs
