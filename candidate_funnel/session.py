"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators count on: a hot key is split by the
# adaptive skew join even when a later step wants rows grouped by that key.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Comparing candidates costs far more than their bytes suggest, so shuffles
    # are not merged below the parallelism at hand.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session the caller owns."""
    for name, value in ADAPTIVE.items():
        spark.conf.set(name, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared folder for cut lineage.

    The cluster's own ``spark.checkpoint.dir`` always wins. Only a local
    session without one gets a scratch folder; a cluster without one is an
    error, because a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    A parquet table rather than an RDD checkpoint, so that later readers
    prune columns and see the true size when a join strategy is chosen.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.__dict__["_cut_path"] = path
    return held


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again; others are left alone.

    For loops: a round's tables go once the next state, itself a table, is written.
    """
    for df in frames:
        path = df.__dict__.pop("_cut_path", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
