"""Filters and rankings within a key.

A key may hold a large share of all rows, so nothing here hands a whole key to
one task: per-key minima and totals are aggregated map-side and joined back
with salt, top-k keeps only k rows per key and map task before its shuffle, and full
ranks of very large keys are computed over range slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.functions.scalars import BOLTZMANN_EV_PER_K, EV_TO_KCAL, column
from candidate_funnel.operators import skew
from candidate_funnel.session import cut


def converged(df: DataFrame, flag: str = "status") -> DataFrame:
    """Keep rows whose status is zero, or whose boolean flag is set."""
    boolean = df.schema[flag].dataType.typeName() == "boolean"
    return df.where(F.col(flag) if boolean else F.col(flag) == 0)


def _bounded(bound: int | None) -> bool:
    return bound is not None and bound <= skew.HOT_ROWS


def with_lowest(
    df: DataFrame, keys: Sequence[str], score: str, name: str, bound: int | None = None
) -> DataFrame:
    """Attach the minimum score of each key.

    ``bound``, here and below, is a row count per key that the caller has
    enforced or measured; small ones let a window replace the join.
    """
    df = skew.keyed(df, keys)
    if _bounded(bound):
        return df.withColumn(name, F.min(score).over(Window.partitionBy(*keys)))
    lowest, hot = _lowest(df, keys, score, name)
    return skew.hot_join(df, lowest, keys, hot=hot)


def _lowest(
    df: DataFrame, keys: Sequence[str], score: str, name: str
) -> tuple[DataFrame, DataFrame | bool]:
    """Minimum per key, and from the same pass the keys whose joins need salt."""
    counted = cut(df.groupBy(*keys).agg(F.min(score).alias(name), F.count("*").alias("_n")))
    hot = skew.slots(counted, keys)
    return counted.drop("_n"), False if hot.isEmpty() else hot


def within(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    width: float = 10.0,
    factor: float = 1.0,
    bound: int | None = None,
) -> DataFrame:
    """Keep rows at most ``width`` above the minimum of their key, inclusive."""
    gap = (F.col(score) - F.col("_lowest")) * F.lit(factor)
    return with_lowest(df, keys, score, "_lowest", bound).where(gap <= width).drop("_lowest")


def relative(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    factor: float = EV_TO_KCAL,
    name: str = "rel",
    bound: int | None = None,
) -> DataFrame:
    """Score above the minimum of the key, in the converted unit."""
    gap = (F.col(score) - F.col("_lowest")) * F.lit(factor)
    return with_lowest(df, keys, score, "_lowest", bound).withColumn(name, gap).drop("_lowest")


def boltzmann(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    temperature: float = 298.15,
    name: str = "weight",
    bound: int | None = None,
) -> DataFrame:
    """Attach normalised populations at ``temperature`` kelvin.

    Minimum and partition sum come from narrow projections; the full rows are
    joined once.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    factor = F.exp(-(F.col(score) - F.col("_lowest")) / F.lit(BOLTZMANN_EV_PER_K * temperature))
    if _bounded(bound):
        lowered = with_lowest(df, keys, score, "_lowest", bound).withColumn("_factor", factor)
        total = F.sum("_factor").over(Window.partitionBy(*keys))
        return lowered.withColumn(name, F.col("_factor") / total).drop("_lowest", "_factor")
    df = skew.keyed(df, keys)
    lowest, hot = _lowest(df, keys, score, "_lowest")
    totals = (
        skew.hot_join(df.select(*keys, score), lowest, keys, hot=hot)
        .groupBy(*keys)
        .agg(F.min("_lowest").alias("_lowest"), F.sum(factor).alias("_total"))
    )
    return (
        skew.hot_join(df, totals, keys, hot=hot)
        .withColumn(name, factor / F.col("_total"))
        .drop("_lowest", "_total")
    )


def _ordering(order: Sequence[str | Column]) -> list[Column]:
    """Ascending, what is missing last, unless a column says otherwise."""
    return [F.asc_nulls_last(c) if isinstance(c, str) else c for c in order]


def rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "rank",
    hot_rows: int | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 in the given total order.

    While no key exceeds ``hot_rows`` this is a plain window. Otherwise rows
    are range-partitioned on key and order, numbered inside their slice, and
    shifted by the rows of the same key in earlier slices.
    """
    size = skew.largest_group(df, keys) if bound is None else bound
    if size <= (hot_rows or skew.HOT_ROWS):
        window = Window.partitionBy(*keys).orderBy(*_ordering(order))
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(slices, *[F.col(k) for k in keys], *_ordering(order)).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(*_ordering(order))
    return (
        placed.withColumn("_local", F.row_number().over(inner))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_slice", "_local", "_offset")
    )


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    k: int = 20,
    name: str | None = None,
) -> DataFrame:
    """Keep the first ``k`` rows of each key, optionally with their position."""
    window = Window.partitionBy(*keys).orderBy(*_ordering(order))
    ranked = df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= k)
    if name:
        ranked = ranked.withColumn(name, F.col("_place").cast("bigint"))
    return ranked.drop("_place")


def cap_per_key(
    df: DataFrame,
    keys: Sequence[str],
    allowance: str | Column,
    order: Sequence[str | Column],
    cap: int = 500,
) -> DataFrame:
    """Keep at most ``allowance`` rows of each key, which ``cap`` must bound.

    The constant bound lets Spark trim each key before the shuffle; an
    allowance above it is an error.
    """
    allowed = column(allowance)
    message = F.format_string("allowance %s is above the cap %s", allowed.cast("string"), F.lit(str(cap)))
    allowed = F.when(allowed > cap, F.raise_error(message).cast("bigint")).otherwise(allowed)
    window = Window.partitionBy(*keys).orderBy(*_ordering(order))
    return (
        df.withColumn("_place", F.row_number().over(window))
        .where((F.col("_place") <= cap) & (F.col("_place") <= allowed))
        .drop("_place")
    )


def representatives(
    df: DataFrame,
    keys: Sequence[str],
    cluster: str,
    score: str,
    tie: str = "cand_id",
    bound: int | None = None,
) -> DataFrame:
    """The lowest-scored member of each cluster."""
    if _bounded(bound):
        return top_k(df, [*keys, cluster], [score, tie], 1)
    first = F.min(F.struct(F.col(score).isNull().alias("_none"), score, tie))
    best = df.groupBy(*keys, cluster).agg(first.alias("_best"))
    chosen = best.select(*keys, F.col(f"_best.{tie}").alias(tie))
    return df.join(chosen, [*keys, tie], "left_semi")
