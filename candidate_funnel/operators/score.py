"""Running a caller's expensive scorer over the surviving candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_scorer(
    df: DataFrame,
    by: Sequence[str],
    open_model: Callable[[], Callable[..., pd.DataFrame]],
    schema: str | T.StructType,
    tasks: int | None = None,
    **limits: float,
) -> DataFrame:
    """Score candidates in Arrow batches with a model opened once per task.

    ``open_model`` returns a function from a batch and the step limits to a
    batch in ``schema``. Rows are few and costly at this point, so they are
    first spread over ``tasks`` by the columns in ``by``, which identify a
    candidate and not just its key. The count is explicit because small
    partitions would otherwise be merged into a few slow tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if len(batch) == 0:
                continue
            if model is None:
                model = open_model()
            yield model(batch, **limits)

    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by).mapInPandas(run, schema)


def stored_scores(df: DataFrame, path: str, schema: str | T.StructType) -> DataFrame:
    """What ``score_into`` has stored so far; empty where nothing is."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return spark.read.schema(schema).parquet(path)


def score_into(
    df: DataFrame,
    by: Sequence[str],
    open_model: Callable[[], Callable[..., pd.DataFrame]],
    schema: str | T.StructType,
    path: str,
    tasks: int | None = None,
    **limits: float,
) -> DataFrame:
    """``apply_scorer`` with its results kept in a table that a rerun goes on from.

    Only rows whose ``by`` the table at ``path`` lacks are scored. A task's rows
    are committed as the task ends, not with the job, so a job that fails or is
    ended late costs the unfinished tasks alone. Rows of one ``by`` meet in one
    task; they are stored together or not at all. The result is what the table
    holds of the candidates in ``df``.

    One table belongs to one model and its limits, and to one writer at a time.
    Without rows to score, no model is opened. Nulls in ``by`` equal each other.
    """
    held = stored_scores(df, path, schema)

    def matches(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        keys = right.select(*[F.col(c).alias(f"_by_{c}") for c in by])
        same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
        return left.join(keys, same, how)

    missing = matches(df, held, "left_anti")
    scored = apply_scorer(missing, by, open_model, schema, tasks, **limits)
    # The committer's second algorithm moves files into place task by task.
    writer = scored.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.parquet(path)
    return matches(stored_scores(df, path, schema), df, "left_semi")
