"""Building and routing the candidate pool of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidate_funnel.operators.skew import hot_join


def expand(
    df: DataFrame, keys: Sequence[str], allowance: str, seed: int = 0xF00D
) -> DataFrame:
    """One row per unit of allowance, with an id and a reproducible seed."""
    return (
        df.where(F.col(allowance) > 0)
        .withColumn("cand_id", F.explode(F.sequence(F.lit(0), F.col(allowance).cast("int") - 1)))
        .withColumn("seed", F.xxhash64(F.lit(seed), *keys, "cand_id"))
    )


def route(items: DataFrame, keys: Sequence[str], item: str, table: DataFrame) -> DataFrame:
    """``primary`` for keys whose every item is in ``table``, else ``fallback``.

    ``table`` holds the covered items, one row each.
    """
    covered = table.select(item).distinct().withColumn("_known", F.lit(True))
    # The item may be one of the keys; a column named twice cannot be joined.
    columns = dict.fromkeys([*keys, item])
    return (
        hot_join(items.select(*columns), covered, [item], "left", repeats=True)
        .groupBy(*keys)
        .agg(F.bool_and(F.col("_known").isNotNull()).alias("_all"))
        .select(*keys, F.when(F.col("_all"), "primary").otherwise("fallback").alias("route"))
    )


def apply_route(
    primary: DataFrame, fallback: DataFrame, routes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Take every row of a key from the one table its route names.

    Both tables meet the routes, worked out once, in one join on key and route.
    """
    tagged = primary.withColumn("_route", F.lit("primary")).unionByName(
        fallback.withColumn("_route", F.lit("fallback"))
    )
    named = routes.select(*keys, F.col("route").alias("_route"))
    return tagged.join(named, [*keys, "_route"], "left_semi").select(primary.columns)


def zip_strict(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pair two arrays by position; unequal lengths are an error."""
    equal = F.size(a) == F.size(b)
    message = F.format_string("cannot pair %d values with %d", F.size(a), F.size(b))
    paired = F.when(equal, F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).otherwise(
        F.raise_error(message)
    )
    others = [c for c in df.columns if c not in (a, b)]
    return df.select(*others, F.posexplode(paired).alias("pos", "_pair")).select(
        *others, "pos", F.col("_pair.a").alias(a), F.col("_pair.b").alias(b)
    )
