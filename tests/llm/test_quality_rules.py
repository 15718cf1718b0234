"""Counts, sketches and thresholds against their definitions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candidate_funnel.llm import quality_rules as qr

from .test_sql import both

WORD = r"[^\x20\x09-\x0D]+"


def plainly(text):
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    stretches = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, s in enumerate(stretches) if stretches.count(s) > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), symbols, len(lines), repeats, len(covered)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(["a", "b", "é", "🙂#", " ", "\n", "\t", "a b c", "\x85", " ", "<&>"]), max_size=40).map("".join))
def test_counts(text):
    assert qr.counts(text.encode()) == plainly(text)


def test_buckets(spark):
    values = [*range(200), 1000, 12345, 10**9, 2**40 + 12345]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", qr.bucket(F.col("v")).alias("b")).collect()
    for r in rows:
        assert r["b"] <= r["v"] and (r["v"] - r["b"]) * 32 <= r["v"] and (r["v"] >= 64 or r["b"] == r["v"])


def good(i, words=60):
    return " ".join(f"w{i}x{k:03d}" for k in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    # Source "long" writes longer words; a pair too small for its own fences takes those of the language.
    rows = [(i, good(i), "en", "plain") for i in range(150)]
    rows += [(1000 + i, " ".join(f"{'y' * 20}{i}x{k:03d}" for k in range(60)), "en", "long") for i in range(150)]
    rows += [(2000 + i, good(i), None, None) for i in range(5)]
    rows += [
        (3000, " ".join(f"{'y' * 20}x{k:03d}" for k in range(60)), "en", "plain"),
        (3001, " ".join(f"# w{k}" for k in range(60)), "en", "plain"),
        (3002, "same line\n" * 40 + good(1), "en", "plain"),
        (3003, "a b c d e " * 20, "en", "plain"),
        (3004, "short", "en", "plain"),
        (3005, None, "en", "plain"),
        (3006, good(7), "xx", "only"),
    ]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, kept int, n string")


def test_verdicts(docs):
    rows = {r["doc_id"]: r for r in qr.judged(docs).collect()}
    dropped = {i for i, r in rows.items() if not r["kept"]}
    assert dropped == {3000, 3001, 3002, 3003, 3004, 3005}
    assert {i for i, r in rows.items() if r["base_failed"]} == {3002, 3003, 3004, 3005}


def test_accepted_keeps_columns(docs):
    out = qr.accepted(docs)
    assert out.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in qr.judged(docs).where("kept").collect())


def test_sketches_merge(docs):
    measured = qr.measure(docs, keep=["lang", "source"])
    key = lambda df: sorted(map(str, df.collect()))
    parts = qr.sketch(measured.where("n_words % 2 = 0"), ["lang"]).unionByName(qr.sketch(measured.where("n_words % 2 = 1"), ["lang"]))
    assert key(qr.merge(parts, ["lang"])) == key(qr.sketch(measured, ["lang"]))
    assert key(qr.merge(qr.sketch(measured, ["lang", "source"]), ["lang"])) == key(qr.sketch(measured, ["lang"]))


def test_many_groups_are_joined_without_broadcast(docs, monkeypatch):
    want = sorted(map(str, qr.judged(docs).collect()))
    monkeypatch.setattr(qr, "BROADCAST_ROWS", 0)
    assert sorted(map(str, qr.judged(docs).collect())) == want


def test_sql_on_odd_rows(spark, odd_dir):
    ours, theirs = both(spark, "op12_quality_rules", odd_dir)
    assert ours == theirs
