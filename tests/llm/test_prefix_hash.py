import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from candidate_funnel.llm import prefix_hash as P


def hashes(text):
    return [P.prefix(P.codes(text), k) for k in range(len(P.BASES))]


def test_spans_and_extensions():
    rng = random.Random(1)
    a = "".join(rng.choice("abé🙂") for _ in range(3000))
    b = a[100:900] + "x" + a[901:2000] + a[:500]
    h, g = hashes(a), hashes(b)
    for _ in range(300):
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        n = rng.randrange(1, 6)
        if max(i + n, j + n) < 2000:
            assert P.same_span(h, i, g, j, n) == (a[i : i + n] == b[j : j + n])
        m = 0
        while i + m < len(a) and j + m < len(b) and a[i + m] == b[j + m]:
            m += 1
        assert P.common_extension(h, i, g, j) == m
    assert P.common_extension(h, 100, g, 0) >= 800


def test_prefix_by_definition():
    text = "poly🙂nomial"
    want, total = [0], 0
    for i, c in enumerate(text):
        total = (total + (ord(c) + 1) * pow(P.BASES[0], i, P.P)) % P.P
        want.append(total)
    assert hashes(text)[0].tolist() == want


def test_likeness_near_jaccard():
    rng = random.Random(2)
    a = "".join(rng.choice("abcdefgh ") for _ in range(8000))
    b = a[:4000] + "".join(rng.choice("abcdefgh ") for _ in range(4000))
    sets = [{t[i : i + P.WINDOW] for i in range(len(t) - P.WINDOW + 1)} for t in (a, b)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    x, y = P.Printed(P.codes(a)), P.Printed(P.codes(b))
    assert abs(P.likeness(x.sketch, y.sketch) - exact) < 0.2
    assert P.likeness(x.sketch, x.sketch) == 1
    assert np.array_equal(P.parse(x.text()), x.sketch)
    values = P.windows(x.h[0])
    assert P.smallest(values).tolist() == sorted(set((values >> np.uint64(32)).tolist()))[: P.SKETCH]


def test_whole_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in P.edited(docs, n=7).collect()}
    own = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    for (i, t), (_, following) in zip(own, own[1:] + own[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i]["edited_fingerprint"] == P.Printed(P.codes(new)).text()
        assert rows[i]["fingerprint"] == P.Printed(P.codes(t)).text()
        assert 0 <= rows[i]["near_next"] <= 1


def test_thousands_of_ranges_and_hot_ids(spark):
    """2,000 ranges; one id and null of many rows, each spread over several."""
    rows = [(i, f"text number {i} of many") for i in range(600)]
    rows += [(77, f"the same id {i}") for i in range(400)] + [(None, f"no id {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = P.in_order(docs, "doc_id", "text", 2000)
    parts = placed.where("_guest = 0").groupBy("_id").agg(F.count_distinct("_bucket").alias("n")).collect()
    spread = {r["_id"]: r["n"] for r in parts}
    assert spread[77] > 50 and spread[None] > 50
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    own = [r["text"] for r in sorted(hashed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))]
    for n in (2000, 3):
        got = {r["fingerprint"]: r["edited_sha256"] for r in P.edited(docs, n=n).collect()}
        assert len(got) == len(own)
        for t, following in zip(own, own[1:] + own[:1], strict=True):
            half = len(t) // 2
            new = t[: len(t) - half] + following[:half]
            assert got[P.Printed(P.codes(t)).text()] == hashlib.sha256(new.encode()).hexdigest()
