"""Repairs against an exhaustive search, over batch borders, and their SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from candidate_funnel.llm import structure_repair as sr

from .test_sql import both

PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "b" if not tail else "d" if (role, text) in seen else "t" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def cheapest(rows):
    """Least (cost, audit) with the repaired turns, over all edits of up to two insertions at a place."""
    kinds = faults(rows)
    best = None

    def go(i, cost, audit, turns, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(t[0][:1] for t in turns)
        if i == len(rows) and PATTERN.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, turns)
        if inserted < 2:
            for r in sr.ROLES:
                go(i, cost + 3, audit + "I", [*turns, (r, "")], inserted + 1)
        if i == len(rows):
            return
        role, text = rows[i]
        go(i + 1, cost + 4, audit + "D", turns, 0)
        if kinds[i] not in ("b", "d"):
            extra = 3 if kinds[i] == "t" else 0
            if role:
                go(i + 1, cost + extra, audit + "K", [*turns, (role, text)], 0)
            for r in sr.ROLES:
                go(i + 1, cost + extra + 3, audit + "R", [*turns, (r, text)], 0)

    go(0, 0, "", [], 0)
    return best


def made(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for conv in range(n):
        rows = [
            (rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", ""]), rnd.choice(["yes.", "no?", "so", "", " \n", "ok. \t"]) + str(rnd.randrange(3)) * rnd.randrange(2))
            for _ in range(rnd.randrange(1, 5))
        ]
        out.append((conv, rows))
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_exhaustive(spark, batch):
    convs = made(5)
    rows = [(c, t, r, x, "a") for c, turns in convs for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, _role string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        reports = {r["conv_id"]: r for r in sr.report(df).collect()}
        turns = sr.repaired(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(reports) == len(convs)
    for conv, given in convs:
        cost, audit, left = cheapest(given)
        r, kinds = reports[conv], faults(given)
        assert (r["cost"], r["audit"]) == (cost, audit), given
        text = "\n".join(f"{a}:{b}" for a, b in left)
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        mine = sorted((t["position"], t["role"], t["text"]) for t in turns if t["conv_id"] == conv)
        assert mine == [(k, *t) for k, t in enumerate(left, 1)]
        assert [r[x] for x in ("blank", "duplicate", "truncated")] == [kinds.count(x) for x in "bdt"]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(given, given[1:])]
        assert r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_long_conversation_holds_no_rows(spark):
    """A conversation of many batches has the repair of its parts."""
    n = 30_000
    df = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("turn "), F.col("id"), F.when(F.col("id") % 1000 == 999, "").otherwise(".")).alias("text"),
    )
    r = sr.report(df.repartition(5)).first()
    assert r["audit"] == "K" * n and r["cost"] == 3 * 30 and r["truncated"] == 30 and r["gaps"] == 0


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a."), (None, 5, "assistant", "b."),
        (7, None, "system", "s."), (7, None, "user", "u."), (7, 9, "assistant", "x" * 300_000 + "!"), (8, 2, "é", "é."),
    ]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, gaps string")
    out = {r["conv_id"]: r for r in sr.report(df).collect()}
    assert set(out) == {None, 7, 8}
    # The null row comes first: a blank text of role " ".
    assert out[None]["audit"] == "DKDK" and out[None]["gaps"] == 1 and out[None]["blank"] == out[None]["duplicate"] == 1
    assert out[7]["audit"] == "KKK" and out[7]["gaps"] == 0
    assert out[8]["audit"] == "D" and out[8]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    gone = sr.report(df, gone=F.col("turn").isNotNull())
    assert {r["conv_id"]: (r["audit"], r["gaps"]) for r in gone.collect()} == {None: ("D", 0), 7: ("KKI", 0), 8: ("", 0)}


def test_one_shuffle_no_group(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.")], "conv_id bigint, turn bigint, role string, text string")
    plan = sr.report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInPandas") == 2 and "Grouped" not in plan


def test_sql_on_odd_rows(spark, odd_dir):
    ours, theirs = both(spark, "op11_structure_repair", odd_dir)
    assert ours == theirs


@pytest.mark.parametrize("edit", range(5))
def test_damage(spark, edit):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    kind = F.pmod(F.crc32(F.concat("conv_id", F.lit(":"), "turn").cast("binary")), F.lit(20))
    before = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in df.where(kind == edit).collect()}
    after = {}
    for r in sr.damaged(df).where(kind == edit).collect():
        after.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["gone"]))
    assert before.keys() == after.keys()
    for spot, (role, text) in before.items():
        want = {0: (role, "", True), 1: (role, "", False), 2: (role, re.sub("[.!?]", "", text), False), 3: (role, text, False), 4: ("user", text, False)}[edit]
        assert after[spot] == [want] * (2 if edit == 3 else 1)
