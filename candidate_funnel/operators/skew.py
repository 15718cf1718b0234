"""Joins on keys of which one may hold a large share of all rows.

Adaptive execution splits a skewed join only where both inputs come straight
from a shuffle. A side that was aggregated by the same key does not, so those
joins are salted here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidate_funnel.session import cut

# Rows of one key that a single task may hold.
HOT_ROWS = 1_000_000

# Rows of a few numbers each that a task sorts or holds at a time, where their number
# is known before.
TASK_ROWS = 1_000_000


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no null part: the others belong to no key."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key (one narrow, map-side combined job)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def hot_keys(df: DataFrame, on: Sequence[str], limit: int | None = None) -> DataFrame:
    """Keys of more than ``limit`` rows, with the number of ``_slots`` to spread over.

    There are fewer of them than rows divided by ``limit``: with the default,
    some hundred thousand for 100 TB, which is what makes them fit a broadcast.
    """
    limit = limit or HOT_ROWS
    return slots(df.groupBy(*on).agg(F.count("*").alias("_n")), on, limit)


def slots(counts: DataFrame, on: Sequence[str], limit: int | None = None) -> DataFrame:
    """``hot_keys`` from row counts ``_n`` that are at hand already."""
    limit = limit or HOT_ROWS
    found = counts.where(F.col("_n") > limit)
    return found.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_slots"))


def find_hot(df: DataFrame, on: Sequence[str]) -> DataFrame | bool:
    """``hot_keys`` written out for several joins to share, or False if there are none."""
    found = cut(hot_keys(df, on))
    return False if found.isEmpty() else found


def shuffled(df: DataFrame) -> DataFrame:
    """Never broadcast this side of a join, however small it is at the moment.

    For tables that grow with the rows and are joined round by round: each
    broadcast passes the driver, and their sum would follow the input.
    """
    return df.hint("merge")


def hot_join(
    df: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | bool | None = None,
    repeats: bool = False,
    grows: bool = False,
) -> DataFrame:
    """Join ``right`` to ``df``, whose hot keys are spread over several tasks.

    Rows of a hot key get a slot from a hash of the whole row, and the rows of
    ``right`` with that key, few by assumption, go to every slot. ``hot`` is
    the ``find_hot`` of ``df`` where several joins share it.

    Equal rows have equal hashes. Where many of them are to be expected,
    ``repeats`` joins those of hot keys once with their number, at most
    ``HOT_ROWS`` copies in a slot, and lists them again afterwards.

    ``grows`` is for a ``right`` that grows with the rows: see ``shuffled``.
    """
    on = list(on)
    whole = shuffled if grows else (lambda table: table)
    if hot is False:
        return df.join(whole(right), on, how)
    hot = F.broadcast(hot_keys(df, on) if hot is None else hot)
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    if repeats and plain == df.columns:
        salted = _dealt(df, hot, on)
    else:
        slot = F.pmod(F.xxhash64(*plain), F.col("_slots")).cast("int")
        salted = df.join(hot, on, "left").select(
            *df.columns, F.when(F.col("_slots").isNull(), 0).otherwise(slot).alias("_slot")
        )
    every = F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1)
    spread = right.join(hot, on, "left").withColumn("_slot", F.explode(every))
    joined = salted.join(whole(spread.drop("_slots")), [*on, "_slot"], how)
    if "_copies" in salted.columns:
        joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return joined.drop("_slot", "_copies", "_copy")


def parts_for(df: DataFrame, rows: int, limit: int | None = None) -> int | None:
    """Partitions of ``limit`` rows each, or None where the session's number suffices.

    That number is the same for any input, so what a task holds would grow with the rows.
    """
    parts = -(-rows // (limit or TASK_ROWS))
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a ``_slot``; equal ones of hot keys as some rows with their ``_copies``."""
    limit = F.lit(HOT_ROWS)
    single = df.join(hot, on, "left_anti").select(
        *df.columns, F.lit(0).alias("_slot"), F.lit(1).cast("bigint").alias("_copies")
    )
    # Sums are made before the shuffle, so equal rows leave a task as one.
    counted = df.join(hot, on).groupBy(*df.columns, "_slots").agg(F.count("*").alias("_n"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_n") / limit) - 1))
    several = counted.withColumn("_part", part).select(
        *df.columns,
        F.pmod(F.xxhash64(*df.columns) + F.col("_part"), F.col("_slots")).cast("int").alias("_slot"),
        F.least(limit.cast("bigint"), F.col("_n") - F.col("_part") * limit).alias("_copies"),
    )
    return single.unionByName(several)
