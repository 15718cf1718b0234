import pytest
from pyspark.sql import functions as F

from candidate_funnel.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<s>[ROLE]x[TEXT]y</s>\n", "~1~0~2~", "[PART]", "", "<", "é<🙂[", "~", "\n"]


def test_round_trip(spark):
    rows = [(i, t, ["user", "assistant", "assistant"][t % 3], a + b) for i, a in enumerate(HARD) for t, b in enumerate(HARD)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chat(df).withColumn("turns", chat.parse(F.col("formatted")))
    for r in out.collect():
        mine = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == mine
        body = r["formatted"]
        # Adjacent assistant turns share one opening.
        assert body.count(chat.OPEN) == sum(k == 0 or mine[k - 1][0] != m[0] for k, m in enumerate(mine))
        masked = [body[s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        back = [m.replace("~2", "[").replace("~1", "<").replace("~0", "~") for m in masked]
        assert back == [t for role, t in mine if role == "assistant"]


@pytest.mark.parametrize("kind", ["Python", "Pandas", "Arrow"])
def test_no_python_in_the_plan(spark, kind):
    df = chat.planted(spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string"))
    assert kind not in chat.digest(chat.format_chat(df))._jdf.queryExecution().executedPlan().toString()
