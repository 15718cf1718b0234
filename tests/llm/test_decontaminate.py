import random

import pytest

from candidate_funnel.llm import decontaminate as D


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([6, 15, 22, 31, 44, 59])))) for i in range(40)]
    docs, truth = [], {}
    for d in range(150):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 300))]
        if d % 5 == 0:
            i, item = rng.choice(items)
            at = rng.randrange(len(t) + 1)
            t[at:at] = item.split()
            truth[d] = i
        docs.append((d, " ".join(t)))
    return items, docs, truth


def brute(index, items, ws):
    """Items found by trying every stretch of every length."""
    out = {}
    for k, (item, own) in enumerate(index.items):
        held = index.bags[k]
        # Only stretches with a shingle of the item can be alike.
        if not any(s in held for s in D.shingles(ws)) and len(own) >= D.SHINGLE:
            continue
        top = 0.0
        for a in range(len(ws)):
            for b in range(a + 1, min(len(ws), a + int(1.3 * len(own)) + 8) + 1):
                top = max(top, index.likeness(k, ws[a:b]))
        if top >= D.SIMILARITY - D.SLIP:
            out[item] = top
    return out


def test_planted_passages(spark, corpus):
    items, docs, truth = corpus
    b = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r["doc_id"]: {h["item_id"] for h in r["hits"]} for r in D.find(df, b).collect()}
    index = D.Index([(i, t.encode()) for i, t in items])
    for d, t in docs:
        assert set(brute(index, items, t.encode().split())) == found[d]
    assert {d for d, h in found.items() if h} == set(truth)
    assert all(truth[d] in found[d] for d in truth)
    clean = {r["doc_id"] for r in D.clean(df, b).collect()}
    assert clean == {d for d, _ in docs} - set(truth)


def test_blocks_of_the_benchmark(spark, corpus, monkeypatch):
    items, docs, truth = corpus
    rows = [(d, t) for d, t in docs] + [(None, None), (7, ""), (0, docs[0][1])]
    b = spark.createDataFrame([*items, (90, None), (91, " "), items[3]], "item_id bigint, text string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    def finds():
        return sorted((str(r["doc_id"]), [(h["item_id"], round(h["similarity"], 9)) for h in r["hits"]]) for r in D.find(df, b).collect())

    whole = finds()
    monkeypatch.setattr(D, "BLOCK_BYTES", 900)
    monkeypatch.setattr(D, "MOST_PARTS", 3)
    made = list(D.blocks(b, "item_id", "text"))
    assert len(made) > 3 and sum(len(block[0]) for block in made) == len(items) + 1
    assert all(sum(len(t) for _, t in block[0]) <= 900 for block in made)
    assert finds() == whole and len(whole) == len(rows)


def edited(rng, own, how):
    """A copy of an item's words with one kind of edit."""
    ws, n = list(own), len(own)
    if how == "start":
        return ws[int(n * rng.uniform(0.05, 0.15)) :]
    if how == "end":
        return ws[: n - int(n * rng.uniform(0.05, 0.15))]
    at = rng.randrange(5, n - 5)
    if how == "insert":
        ws[at:at] = [f"new{rng.random()}" for _ in range(rng.randrange(1, 5))]
    elif how == "delete":
        del ws[at : at + rng.randrange(1, 4)]
    else:
        ws[at] = "changed"
    return ws


@pytest.mark.parametrize("how", ["start", "end", "insert", "delete", "change"])
def test_shortened_and_lengthened_copies(how):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 91)))) for i in range(300)]
    index = D.Index([(i, t.encode()) for i, t in items])
    texts, want = [], []
    for k, (i, t) in enumerate(items):
        copy = " ".join(edited(rng, t.split(), how)).encode().split()
        around = [[rng.choice(words).encode() for _ in range(rng.randrange(0, 60))] for _ in range(2)]
        texts.append(b" ".join([*around[0], *copy, *around[1]]))
        # What the copy alone is worth is a lower bound for its best stretch.
        want.append(i if index.likeness(k, copy) >= D.SIMILARITY else None)
    got = index.search(texts)
    due = [(i, {h for h, _ in hits}) for i, hits in zip(want, got, strict=True) if i is not None]
    assert len(due) >= 100
    assert sum(i in hits for i, hits in due) >= 0.97 * len(due)


def test_best_stretch_by_definition():
    rng = random.Random(5)
    for _ in range(60):
        few = [bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(5, 16))]
        index = D.Index([(0, b" ".join(few)), (1, b"a b a b c d"), (2, b"b b")], 0.5)
        part = [bytes([97 + rng.randrange(2)]) for _ in range(rng.randrange(0, 25))]
        part[3:3] = few[: rng.randrange(len(few) + 1)]
        for k in range(3):
            spans = [(a, b) for a in range(len(part)) for b in range(a + 1, len(part) + 1)]
            top = max((index.likeness(k, part[a:b]) for a, b in spans), default=0.0)
            assert abs(index.best(k, part) - (top if top >= 0.5 - D.SLIP else 0.0)) < 1e-8


def test_all_fingerprints_within_the_radius(corpus):
    items, docs, _ = corpus
    index = D.Index([(i, t.encode()) for i, t in items])
    texts = [D.words(t.encode()) for _, t in docs[:20]]
    total, ends = index.signs(texts)
    got = index.candidates(texts)
    for window, stride, prints, owner, offset, _ in index.groups:
        made, first = index.simhash(total, ends, window, stride)
        for m, at in zip(made.tolist(), first.tolist(), strict=True):
            d = max(k for k in range(len(texts)) if ends[k] <= at and ends[k] < ends[k + 1])
            for p, o, off in zip(prints.tolist(), owner.tolist(), offset.tolist(), strict=True):
                if bin(m ^ p).count("1") <= D.RADIUS:
                    assert (o, at - int(ends[d]) - off) in got[d]


def test_changed_words(corpus):
    items, _, _ = corpus
    index = D.Index([(i, t.encode()) for i, t in items])
    for i, t in items:
        w = t.split()
        if len(w) == 59:
            w[30] = "changed"
            hits = dict(index.search([("before it " + " ".join(w) + " after").encode()])[0])
            assert 0.8 <= hits[i] < 1


def test_items_without_an_id_and_repeated_ones():
    own = b" ".join(b"w%d" % i for i in range(20))
    index = D.Index([(3, own), (None, own), (3, own), (1, b"w1 w2")])
    hits = index.search([b"x " + own + b" y", b"", b"x y"])
    assert hits == [[(None, 1.0), (1, 1.0), (3, 1.0), (3, 1.0)], [], []]
