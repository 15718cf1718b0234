"""One vector per key from the feature vectors of its candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.functions.scalars import AGGREGATIONS, STATISTICS
from candidate_funnel.operators.select import boltzmann
from candidate_funnel.operators.skew import hot_join, slots
from candidate_funnel.session import cut


def _known(mode: str) -> None:
    if mode not in AGGREGATIONS:
        raise ValueError(f"no such way to pool features: {mode!r}; there are {', '.join(AGGREGATIONS)}")


def aggregated_width(n_features: int, mode: str) -> int:
    """Length of the vector an aggregation yields."""
    _known(mode)
    return n_features * len(STATISTICS) if mode == "ensemble_stats" else n_features


def feature_columns(n_features: int, mode: str) -> list[str]:
    """Column labels of the aggregated vector, block by block."""
    _known(mode)
    blocks = STATISTICS if mode == "ensemble_stats" else (mode,)
    return [f"{block}_{i}" for block in blocks for i in range(n_features)]


def validate(
    features: DataFrame,
    ensemble: DataFrame,
    keys: Sequence[str],
    vector: str = "features",
    ident: str = "cand_id",
) -> DataFrame:
    """``(keys, outcome)``: ok, not_a_matrix, count_mismatch, or id_mismatch.

    Ids mismatch where some candidate has not exactly one row on either side.
    """
    return _checked(features, ensemble, keys, vector, ident).select(*keys, "outcome")


def _checked(
    features: DataFrame, ensemble: DataFrame, keys: Sequence[str], vector: str, ident: str
) -> DataFrame:
    """``validate`` with the number of feature rows of each key, ``_n``."""
    rows = features.select(
        *keys, F.col(ident).alias("_id"), F.coalesce(F.size(vector), F.lit(-1)).alias("_w"), F.lit(1).alias("_f"), F.lit(0).alias("_e")
    )
    members = ensemble.select(
        *keys, F.col(ident).alias("_id"), F.lit(None).cast("int").alias("_w"), F.lit(0).alias("_f"), F.lit(1).alias("_e")
    )
    each = rows.unionByName(members).groupBy(*keys, "_id").agg(
        F.min("_w").alias("_low"),
        F.max("_w").alias("_high"),
        F.sum("_f").alias("_f"),
        F.sum("_e").alias("_e"),
    )
    found = each.groupBy(*keys).agg(
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
        F.bool_and((F.col("_f") == 1) & (F.col("_e") == 1)).alias("_paired"),
        F.sum("_f").alias("_f"),
        F.sum("_e").alias("_e"),
    )
    outcome = (
        F.when((F.col("_low") != F.col("_high")) | (F.col("_low") < 1), "not_a_matrix")
        .when(F.col("_f") != F.col("_e"), "count_mismatch")
        .when(~F.col("_paired"), "id_mismatch")
        .otherwise("ok")
    )
    return found.select(*keys, outcome.alias("outcome"), F.col("_f").alias("_n"))


def aggregate(
    features: DataFrame,
    ensemble: DataFrame,
    keys: Sequence[str],
    mode: str = "lowest",
    temperature: float = 298.15,
    ident: str = "cand_id",
    score: str = "score",
    vector: str = "features",
    strict: bool = False,
) -> DataFrame:
    """Long vectors ``(keys, pos, value)`` of every valid key.

    ``pos`` runs over the blocks of ``ensemble_stats`` in order. Keys that
    ``validate`` rejects are left out, or raise with ``strict``.
    """
    _known(mode)
    keys = list(keys)
    # Written once: outcomes pick the rows, counts tell which keys need salt.
    checked = cut(_checked(features, ensemble, keys, vector, ident))
    hot = slots(checked, keys)
    hot = False if hot.isEmpty() else hot
    if strict:
        ok = F.when(F.col("outcome") == "ok", True).otherwise(F.raise_error(F.col("outcome")))
        valid = checked.where(ok).select(*keys)
    else:
        valid = checked.where(F.col("outcome") == "ok").select(*keys)
    rows = hot_join(features.select(*keys, ident, F.col(vector).alias("_v")), valid, keys, "left_semi", hot)
    scores = ensemble.select(*keys, ident, score)
    values = F.posexplode("_v").alias("pos", "value")

    if mode == "lowest":
        first = scores.groupBy(*keys).agg(F.min(F.struct(score, ident)).alias("_first"))
        chosen = first.select(*keys, F.col(f"_first.{ident}").alias(ident))
        return rows.join(chosen, [*keys, ident]).select(*keys, values)

    if mode == "boltzmann":
        weights = boltzmann(scores, keys, score, temperature, "_weight")
        weighted = rows.join(weights.select(*keys, ident, "_weight"), [*keys, ident])
        return (
            weighted.select(*keys, "_weight", values)
            .groupBy(*keys, "pos")
            .agg(F.sum(F.col("_weight") * F.col("value")).alias("value"))
        )

    blocks = (
        rows.select(*keys, values, F.size("_v").alias("_width"))
        .groupBy(*keys, "pos")
        .agg(
            F.max("_width").alias("_width"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
        )
    )
    stacked: Column = F.posexplode(F.array(*STATISTICS)).alias("_block", "value")
    return blocks.select(*keys, "pos", "_width", stacked).select(
        *keys, (F.col("_block") * F.col("_width") + F.col("pos")).alias("pos"), "value"
    )


def vectors(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Array form of long vectors; its length is the width of the features."""
    cells = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return long.groupBy(*keys).agg(F.transform(cells, lambda c: c["value"]).alias("features"))


def to_columns(
    packed: DataFrame, keys: Sequence[str], n_features: int, mode: str, vector: str = "features"
) -> DataFrame:
    """Array vectors as one labelled column per value; other lengths are an error."""
    labels = feature_columns(n_features, mode)
    message = F.format_string("%d values for %d labels", F.size(vector), F.lit(len(labels)))
    fits = F.when(F.size(vector) == len(labels), F.col(vector)).otherwise(F.raise_error(message))
    held = packed.select(*keys, fits.alias("_v"))
    return held.select(*keys, *[F.get("_v", F.lit(i)).alias(c) for i, c in enumerate(labels)])
