"""Ordered ensembles of the surviving candidates.

The long form has one row per member: ``(keys, position, cand_id, energy,
coords, n, charge, multiplicity)`` with position 0 the lowest energy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.functions.scalars import EV_TO_KCAL, column
from candidate_funnel.operators.select import top_k
from candidate_funnel.operators.skew import hot_join


# What a key has besides its members.
TOTALS = ("charge", "multiplicity", "numbers")


def assemble(
    df: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    ident: str = "cand_id",
    coords: str = "coords",
    totals: DataFrame | None = None,
    max_final: int = 20,
) -> DataFrame:
    """The ``max_final`` lowest candidates of each key, in energy order.

    Coordinates become single precision here and not before. ``totals`` holds
    ``(keys, charge, multiplicity)`` and, if at hand, ``numbers``, the atomic
    numbers in atom order.
    """
    keys = list(keys)
    members = top_k(df, keys, [score, ident], max_final, "_rank")
    whole = Window.partitionBy(*keys)
    result = members.select(
        *keys,
        (F.col("_rank") - 1).alias("position"),
        F.col(ident),
        F.col(score).cast("double").alias("energy"),
        F.col(coords).cast("array<float>").alias("coords"),
        F.count("*").over(whole).alias("n"),
    )
    if totals is not None:
        held = [c for c in TOTALS if c in totals.columns]
        result = result.join(totals.select(*keys, *held), keys, "left")
    return result


def shaped(coords: Column, dims: int) -> Column:
    """Flat coordinates atom by atom."""
    atoms = F.sequence(F.lit(0), (F.size(coords) / dims).cast("int") - 1)
    return F.transform(atoms, lambda i: F.slice(coords, i * dims + 1, F.lit(dims)))


def pack(ens: DataFrame, keys: Sequence[str], width: int = 20, dims: int | None = None) -> DataFrame:
    """One row per key with the members as arrays.

    With ``dims`` coordinates are nested: members, atoms, values of an atom.

    ``width`` must be the ``max_final`` the ensemble was assembled with: a
    longer one is an error, so no array outgrows it.
    """
    totals = [c for c in TOTALS if c in ens.columns]
    listed = F.sort_array(F.collect_list(F.struct("position", "energy", "coords"))).alias("_m")
    first = [F.max(c).alias(c) for c in totals]
    fits = F.col("position") < width
    guarded = F.when(fits, F.col("position")).otherwise(F.raise_error("ensemble wider than declared"))
    return (
        ens.withColumn("position", guarded)
        .groupBy(*keys)
        .agg(listed, *first)
        .select(
            *keys,
            F.transform("_m", lambda m: m["energy"]).alias("energies"),
            F.transform(
                "_m", lambda m: m["coords"] if dims is None else shaped(m["coords"], dims)
            ).alias("coords"),
            *totals,
        )
    )


def size_of(ens: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ens.groupBy(*keys).agg(F.count("*").alias("n"))


def lowest(ens: DataFrame) -> DataFrame:
    """The first member of each ensemble."""
    return ens.where(F.col("position") == 0)


def as_atoms(
    ens: DataFrame, nodes: DataFrame, keys: Sequence[str], dims: int = 3
) -> DataFrame:
    """Calculator input: one row per atom of each lowest member.

    ``(keys, node_id, number, xyz, charge)`` with ``nodes(keys, node_id,
    number)`` numbered from 0.
    """
    keys = list(keys)
    xyz = F.slice("coords", (F.col("node_id") * dims + 1).cast("int"), F.lit(dims)).alias("xyz")
    atoms = nodes.select(*keys, "node_id", "number")
    first = lowest(ens).select(*keys, "coords", "charge")
    return hot_join(atoms, first, keys).select(*keys, "node_id", "number", xyz, "charge")


def relative_energies(energies: str | Column) -> Column:
    """Energies of a packed ensemble above its minimum, in kcal/mol."""
    low = F.array_min(column(energies))
    return F.transform(column(energies), lambda e: (e - low) * F.lit(EV_TO_KCAL))
