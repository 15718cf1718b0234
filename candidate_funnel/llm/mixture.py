"""Mixing sources to target weights with DataFrame functions only.

1. *Targets.* Sources by code point (null last) get weights in turn. The mix is
   ``share`` of all words; a source stops at ``most`` times its size and the
   excess is shared again by weight. The fixed point has a closed form: with
   sources ordered by size/weight, those whose bound lies below the common
   level are bounded, the rest get the level times their weight.
2. *Order.* A document's key is the md5 of its id: random, but the same in every
   run. Its first hexadecimal digits deal the documents of each source into
   buckets of some thousand rows; buckets are ranges of the key, so ordering
   buckets and the rows inside them orders the source. A source of any size is
   spread over as many tasks as it has buckets.
3. *Prefix sums.* Bucket totals are summed over the buckets before, and row
   totals inside each bucket, so no task sees more than a bucket.
4. *Cut.* A source is taken ``floor(target / size)`` times as a whole, then up to
   its exact remaining budget; the document at the cut gives its first words.

The table of sources (one row each) is ordered in one task; documents never are.

Defined results: null texts have no words and are never taken; a null source is
a source; rows of one id tie by size, rows equal in both are interchangeable;
sources without words have target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.llm.common import n_words
from candidate_funnel.session import cut

# Fixed values of the production mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

# Rows of one bucket, on average, at most.
BUCKET_ROWS = 4096


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_source, source_size) gets the columns ``weight`` and ``target``.

    The mean of the values in ``weights`` is not needed: targets depend on the
    ratios alone.
    """
    order = Window.orderBy(F.asc_nulls_last("_source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    given = sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    bound = (F.col("source_size") * most).cast("double")
    all_ = Window.partitionBy()
    level = Window.orderBy(bound / F.col("weight"), F.asc_nulls_last("_source"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        given.withColumn("_all", F.sum("source_size").over(all_) * F.lit(float(share)))
        .withColumn("_gone", F.coalesce(F.sum(bound).over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(after))
        # Bounded, if even alone with those after it the source gets too much.
        .withColumn(
            "_bounded",
            (F.col("_all") - F.col("_gone")) * F.col("weight") >= bound * F.col("_weights"),
        )
        # Of the first that is not bounded: what is left, and among how many.
        .withColumn("_left", F.first(F.when(~F.col("_bounded"), F.col("_all") - F.col("_gone")), True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_among", F.first(F.when(~F.col("_bounded"), F.col("_weights")), True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("_bounded"), bound).otherwise(
        F.col("_left") * F.col("weight") / F.col("_among")
    )
    return ranked.select("_source", "source_size", "weight", target.alias("target"))


def key(id_column: str) -> Column:
    """The random key: 32 hexadecimal digits that order as text."""
    return F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def mix(
    docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
) -> DataFrame:
    """(id, size, source_size, target, taken, before) of every document.

    ``taken`` counts repeats; ``before`` is the number of words of the source
    that come before the document in the order of an epoch.
    """
    sized = cut(
        docs.select(
            F.col(id_column).alias("_id"),
            F.col(source).alias("_source"),
            n_words(F.col(text)).alias("size"),
            key(id_column).alias("_key"),
        )
    )
    rows = sized.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 1
    dealt = sized.withColumn("_bucket", F.substring("_key", 1, digits))
    totals = dealt.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    # The sums over buckets are few rows: at most sources times buckets.
    sums = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.coalesce(F.sum("_words").over(sums), F.lit(0)))
    sources = totals.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    budget = targets(sources, weights, share, most)
    budget = budget.select(F.col("_source").alias("_s"), "source_size", "target")
    starts = totals.join(budget, F.col("_source").eqNullSafe(F.col("_s"))).select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_start", "source_size", "target"
    )
    inside = (
        Window.partitionBy("_source", "_bucket")
        .orderBy("_key", "_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = dealt.withColumn("_to", F.sum("size").over(inside))
    joined = summed.join(
        starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))
    )
    size, total = F.col("size"), F.greatest(F.col("source_size"), F.lit(1))
    before = F.col("_start") + F.col("_to") - size
    epochs = F.floor(F.col("target") / total)
    left = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    last = F.least(F.greatest(left - before, F.lit(0)), size)
    return joined.select(
        F.col("_id").alias(id_column),
        size.alias("size"),
        F.col("source_size").cast("long"),
        "target",
        (epochs * size + last).cast("long").alias("taken"),
        before.cast("long").alias("before"),
    )


def materialise(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: a row of ``docs`` per document and epoch in which it is
    taken, with ``epoch``, ``size``, ``target`` and ``taken`` of that row; where
    ``docs`` has a column of one of these names, all four are prefixed ``mix_``
    (again, until none clashes). The document at its source's cut keeps only its
    taken words.
    """
    def numbered(rows: DataFrame, *order) -> DataFrame:
        # Rows of one id and size are told apart by their number.
        own = Window.partitionBy("_mix_key", "_mix_size").orderBy(*order)
        return rows.withColumn("_mix_n", F.row_number().over(own))

    own_key = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null")).alias("_mix_key")
    plan = mix(docs, id_column, source, text).where("taken > 0")
    plan = plan.select(own_key, F.col("size").alias("_mix_size"), F.col("target").alias("_mix_target"), F.col("taken").alias("_mix_taken"))
    rows = docs.select("*", own_key, n_words(F.col(f"`{text}`")).alias("_mix_size"))
    rows = numbered(rows.where("_mix_size > 0"), F.xxhash64(F.col(f"`{text}`")))
    joined = rows.join(numbered(plan, F.desc("_mix_taken")), ["_mix_key", "_mix_size", "_mix_n"])
    epochs = F.ceil(F.col("_mix_taken") / F.col("_mix_size")).cast("int")
    each = joined.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1), epochs)))
    own = F.least(F.col("_mix_size"), F.col("_mix_taken") - (F.col("_mix_epoch") - 1) * F.col("_mix_size"))
    word = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
    held = F.col(f"`{text}`")
    # The first words with what stands between them, for cut documents only.
    short = F.array_join(F.slice(F.regexp_extract_all(held, F.lit(f"({word})"), F.lit(1)), F.lit(1), own.cast("int")), "")
    new = F.when(own < F.col("_mix_size"), short).otherwise(held)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(new.alias(c))
        elif c == "n_chars":
            columns.append(F.when(own < F.col("_mix_size"), F.length(new)).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    extra = [("epoch", F.col("_mix_epoch")), ("size", F.col("_mix_size")), ("target", F.col("_mix_target")), ("taken", own.cast("long"))]
    held = {c.lower() for c in docs.columns}
    while held & {n for n, _ in extra}:
        extra = [(f"mix_{n}", v) for n, v in extra]
    return each.select(*columns, *[v.alias(n) for n, v in extra])
