"""Plans and sessions under a key that holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from candidate_funnel import session
from candidate_funnel.operators import graph, select, skew

PLAIN = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def hot(spark, monkeypatch):
    """A third of the rows under key 0, and nothing to help the salt."""
    before = {name: spark.conf.get(name, None) for name in PLAIN}
    for name, value in PLAIN.items():
        spark.conf.set(name, value)
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)
    yield spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 4999).alias("key"),
        F.rand(7).alias("score"),
        F.col("id").alias("cand_id"),
    )
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("op", ["within", "relative", "boltzmann"])
def test_a_hot_key_is_spread_over_tasks(hot, op):
    df = {
        "within": lambda **k: select.within(hot, ["key"], "score", 2.0, **k),
        "relative": lambda **k: select.relative(hot, ["key"], "score", **k),
        "boltzmann": lambda **k: select.boltzmann(hot, ["key"], "score", **k),
    }[op]
    salted = df()
    sizes = salted.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 60000
    assert max(r["count"] for r in sizes) < 60000 / 4
    # Below the limit the same rows come from a window, a whole key per task.
    skew.HOT_ROWS = 10**6
    windowed = df(bound=10**5)
    name = windowed.columns[-1]
    pairs = windowed.select("cand_id", F.col(name).alias("w")).join(salted, "cand_id")
    assert pairs.where(F.abs(F.col("w") - F.col(name)) <= 1e-12).count() == 60000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salt_changes_no_result(hot, how):
    right = hot.where("key % 3 <> 1").groupBy("key").agg(F.max("score").alias("top"))
    plain = hot.join(right, ["key"], how)
    salted = skew.hot_join(hot, right, ["key"], how)
    assert salted.columns == plain.columns
    assert plain.count() == salted.count()
    assert salted.exceptAll(plain).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equal_rows_are_spread_too(hot, spark, how):
    """40,000 equal rows of one key, and rows that are alone, repeated a little or null."""
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    equal = spark.range(0, 40000, 1, 8).select(F.lit(7).alias("key"), F.lit("same").alias("note"))
    other = spark.range(0, 5000, 1, 4).select(
        F.when(F.col("id") % 9 > 0, F.col("id") % 40).cast("int").alias("key"), (F.col("id") % 3).cast("string").alias("note")
    )
    df = equal.unionByName(other)
    tops = [0, 3, 50, None] if how == "left_anti" else [0, 3, 7, 50, None]
    right = spark.createDataFrame([(k,) for k in tops], "key int")
    right = right if how.startswith("left_") else right.withColumn("top", F.col("key") * 2)
    salted = skew.hot_join(df, right, ["key"], how, repeats=True)
    plain = df.join(right, ["key"], how)
    assert salted.columns == plain.columns
    assert plain.count() == salted.count() > 40000
    assert plain.exceptAll(salted).count() == 0
    used = salted.where("note = 'same'").groupBy(F.spark_partition_id()).count().collect()
    assert len(used) >= 20
    assert max(r["count"] for r in used) <= 4000


def test_cluster_folder_comes_first(spark, monkeypatch):
    root = session.checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()

    class Context:
        master = "yarn"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/cuts"}
    assert session.checkpoint_root(Session()) == "hdfs://shared/cuts"


@pytest.mark.parametrize("hot", [None, False])
def test_a_table_that_grows_with_the_rows_is_never_broadcast(spark, hot):
    rows = spark.range(100).select((F.col("id") % 10).alias("key"), "id")
    few = spark.range(5).select(F.col("id").alias("key"))
    joined = skew.hot_join(rows, few, ["key"], "left_semi", hot=hot, grows=True)
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert hot is None or "BroadcastHashJoin" not in plan


def test_leaves_of_many_edges_are_stripped_in_small_tasks(spark, hot, monkeypatch):
    # Node 0 is a hub of 3,000 leaves, the rest a sparse graph.
    hub = spark.range(3000).select(F.lit(0).cast("bigint").alias("src"), (F.col("id") + 10**6).alias("dst"))
    rest = spark.range(20000).select(
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("src"), (F.col("id") % 15000 + 5000).alias("dst")
    )
    edges = hub.unionByName(rest).distinct().select((F.col("src") % 2).alias("graph_id"), "src", "dst")
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    plain = graph.strip_leaves(nodes, edges)
    monkeypatch.setattr(skew, "TASK_ROWS", 1000)
    for bound in (None, 30000):
        dealt = graph.strip_leaves(nodes, edges, bound)
        for one, other in zip(plain, dealt, strict=True):
            assert one.count() == other.count() > 0
            assert one.exceptAll(other).count() == 0
        sizes = [r["count"] for r in dealt[1].groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 10
        assert max(sizes) < 2000
