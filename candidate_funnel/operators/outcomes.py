"""What became of each key: row counts per stage and the first failure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def funnel_report(
    stages: Mapping[str, DataFrame], keys: Sequence[str], span: tuple[str, str] | None = None
) -> DataFrame:
    """Rows of each key in each stage, and optionally the span of one.

    ``span`` names a stage and a relative-score column whose maximum is
    reported. All stages meet in a single map-side combined aggregation.
    """
    parts = []
    for name, df in stages.items():
        value = F.col(span[1]) if span and span[0] == name else F.lit(None)
        parts.append(df.select(*keys, F.lit(name).alias("_stage"), value.cast("double").alias("_rel")))
    rows = reduce(DataFrame.unionByName, parts)
    counts = [F.count_if(F.col("_stage") == name).alias(name) for name in stages]
    if span:
        counts.append(F.max("_rel").alias("span"))
    return rows.groupBy(*keys).agg(*counts)


def outcomes(
    keyed: DataFrame, stages: Mapping[str, DataFrame], keys: Sequence[str], strict: bool = False
) -> DataFrame:
    """``ok``, or the reason of the first stage a key has no row in.

    ``stages`` maps each reason to the rows that survived that stage. With
    ``strict`` a failing key raises when its row is evaluated.
    """
    parts = [keyed.select(*keys, F.lit(0).alias("_passed"))]
    for place, df in enumerate(stages.values()):
        parts.append(df.select(*keys, F.lit(1 << place).alias("_passed")))
    rows = reduce(DataFrame.unionByName, parts)
    passed = rows.groupBy(*keys).agg(
        F.bit_or("_passed").alias("_passed"), F.bool_or(F.col("_passed") == 0).alias("_listed")
    )
    failed = [
        F.when(F.col("_passed").bitwiseAND(F.lit(1 << place)) == 0, F.lit(reason))
        for place, reason in enumerate(stages)
    ]
    outcome = F.coalesce(*failed, F.lit("ok"))
    if strict:
        named = F.concat(outcome, F.lit(": "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
        outcome = F.when(outcome == "ok", outcome).otherwise(F.raise_error(named))
    return passed.where("_listed").select(*keys, outcome.alias("outcome"))
