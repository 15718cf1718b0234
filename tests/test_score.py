import os
import time
import uuid

import pandas as pd
import pytest

from candidate_funnel.operators import fingerprint as fp
from candidate_funnel.operators.score import score_into

SCHEMA = "key string, cand_id bigint, value double"


def model(folder):
    """Doubles scores; notes each row it sees, fails on row 7 until told better."""

    def open_model():
        def run(batch, **limits):
            if (batch["cand_id"] == 7).any() and not os.path.exists(f"{folder}/mended"):
                time.sleep(4)
                raise RuntimeError("row 7")
            for i in batch["cand_id"]:
                open(f"{folder}/seen-{i}-{uuid.uuid4().hex}", "w").close()
            return pd.DataFrame({"key": batch["key"], "cand_id": batch["cand_id"], "value": batch["score"] * 2})

        return run

    return open_model


def calls(folder):
    return sorted(int(n.split("-")[1]) for n in os.listdir(folder) if n.startswith("seen"))


def test_a_rerun_scores_only_what_is_absent(spark, tmp_path):
    notes, path = tmp_path / "notes", str(tmp_path / "scores")
    notes.mkdir()
    rows = [("a" if i % 3 else None, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, cand_id bigint, score double")
    by = ["key", "cand_id"]
    with pytest.raises(Exception, match="row 7"):
        score_into(df, by, model(notes), SCHEMA, path, tasks=8).count()
    before = calls(notes)
    assert before and 7 not in before
    (notes / "mended").touch()
    got = score_into(df, by, model(notes), SCHEMA, path, tasks=8)
    assert sorted((r.cand_id, r.value) for r in got.collect()) == [(i, 2.0 * i) for i in range(40)]
    # Every row once, those of tasks that had ended before the failure too.
    assert calls(notes) == list(range(40))
    # A part of the candidates is the part of the table, without a call.
    part = score_into(df.where("cand_id < 5"), by, model(notes), SCHEMA, path)
    assert sorted(r.cand_id for r in part.collect()) == [0, 1, 2, 3, 4]
    empty = score_into(df.limit(0), by, model(notes), SCHEMA, str(tmp_path / "none"))
    assert empty.count() == 0 and calls(notes) == list(range(40))


def test_fingerprint_refuses_what_it_cannot_cover(spark, monkeypatch):
    nodes = spark.createDataFrame([(g, n, "C") for g in (1, 2) for n in range(4)], "graph_id int, node_id int, label string")
    edges = spark.createDataFrame([(1, 0, n, "-") for n in (1, 2, 3)] + [(2, 0, 9, "-")], "graph_id int, src int, dst int, label string")
    assert fp.fingerprint(nodes, edges).count() > 0
    with pytest.raises(ValueError, match="1 graphs have edges to unlisted nodes, the first is 2"):
        fp.fingerprint(nodes, edges, strict=True)
    monkeypatch.setattr(fp, "MOST_DEGREE", 2)
    with pytest.raises(ValueError, match="3 edges"):
        fp.fingerprint(nodes, edges, radius=3)
    assert fp.fingerprint(nodes, edges, radius=2).count() > 0
