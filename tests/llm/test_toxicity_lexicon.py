"""The lexicon has no cap, knows short words, and without one nothing is toxic."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candidate_funnel.llm import toxicity as T


def tables(spark, bad, n=1500, toxic_share=0.5, seed=4):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(40)]
        toxic = int(rnd.random() < toxic_share)
        if toxic and bad:
            for _ in range(6):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def caught(docs, labels):
    held = F.col("doc_id") % 5 == 0
    rows = T.classify(docs, labels, held, ~held).join(labels, "doc_id").where("held_out").collect()
    share = lambda k: np.mean([r["predicted"] for r in rows if r["toxic"] == k])
    return share(1), share(0)


@pytest.mark.parametrize("kind", ["many", "short"])
def test_every_entry_stays(spark, kind):
    rnd = random.Random(9)
    if kind == "many":
        bad = ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(5)) for _ in range(250)]
    else:
        bad = ["qzx", "zzq", "xq", "жук"]
    toxic, clean = caught(*tables(spark, bad))
    assert toxic >= 0.95 and clean <= 0.02


def test_nothing_learned_rejects_nothing(spark):
    docs, labels = tables(spark, [])
    assert T.accepted(docs, labels).count() == docs.count()


def test_redundant_stems():
    held = {"badword": 50, "badw*": 52, "badwo*": 50, "badwor*": 50, "hate*": 90, "hater": 40, "hated": 40, "xq": 7}
    assert T.without_redundant(held) == {"badword", "hate*", "hater", "hated", "xq"}
