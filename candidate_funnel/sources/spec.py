"""Declarative dataset descriptions and the frames they stand for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candidate_funnel.operators.skew import hot_join


@dataclass(frozen=True)
class SourceSpec:
    """One benchmark file: where it is and what its columns mean."""

    name: str
    path: str
    target: str
    direction: Literal["max", "min"]
    compounds: tuple[str, ...]
    numeric: tuple[str, ...] = ()
    allowed: frozenset[int] | None = None
    row_id: str | None = None

    def __post_init__(self) -> None:
        if self.direction not in ("max", "min"):
            raise ValueError(f"direction must be 'max' or 'min', got {self.direction!r}")


# The benchmark files, their columns and the default sweep.
REGISTRY = {
    spec.name: spec
    for spec in (
        SourceSpec(
            "bh_full",
            "data/Buchwald_Hartwig.csv",
            "yield",
            "max",
            ("Ligand", "Additive", "Base", "Aryl halide"),
        ),
        SourceSpec(
            "bh_1",
            "data/bh_reaction_1.csv",
            "objective",
            "max",
            ("Ligand", "Additive", "Base", "Aryl halide"),
        ),
        SourceSpec(
            "shields",
            "data/shields_dataset.csv",
            "yield",
            "max",
            ("Solvent_SMILES", "Base_SMILES", "Ligand_SMILES"),
            ("Temp_C", "Concentration"),
        ),
    )
}
DEFAULT_SWEEP = ("bh_full", "bh_1", "shields")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def load(
    spark: SparkSession, spec: SourceSpec, root: str = ".", tokens: DataFrame | None = None
) -> DataFrame:
    """Read a spec's file as ``objective``, its compounds and its numeric columns.

    A spec with ``allowed`` keeps rows all of whose compounds consist of allowed
    tokens; ``tokens(key, token)`` lists those of every compound.

    CSV fields are read as text and cast without raising, so one malformed
    number becomes a null instead of failing the scan.
    """
    path = f"{root.rstrip('/')}/{spec.path}"
    raw = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True)
    columns = [F.col(_quoted(spec.target)).try_cast("double").alias("objective")]
    if spec.row_id:
        columns.insert(0, F.col(_quoted(spec.row_id)).alias("row_id"))
    columns += [F.col(_quoted(c)).cast("string").alias(c) for c in spec.compounds]
    columns += [F.col(_quoted(c)).try_cast("double").alias(c) for c in spec.numeric]
    rows = raw.select(*columns)
    if spec.allowed is None:
        return rows
    if tokens is None:
        raise ValueError(f"{spec.name} restricts its compounds, so their tokens are needed")
    known = F.coalesce(F.col("token").isin(*sorted(spec.allowed)), F.lit(False))
    foreign = tokens.where(~known).select("key").distinct()
    for c in spec.compounds:
        rows = hot_join(rows, foreign.select(F.col("key").alias(c)), [c], "left_anti", repeats=True)
    return rows.select(*raw.select(*columns).columns)


def orient(df: DataFrame, spec: SourceSpec, name: str = "signed") -> DataFrame:
    """Add the objective with its sign turned so that larger is better."""
    return df.withColumn(name, F.col("objective") * F.lit(1.0 if spec.direction == "max" else -1.0))


def best(df: DataFrame, spec: SourceSpec, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` best rows under the spec's direction (a bounded top-n)."""
    return (
        orient(df, spec, "_signed")
        .orderBy(F.desc_nulls_last("_signed"), *ties)
        .limit(n)
        .drop("_signed")
    )


def restrict(df: DataFrame, tokens: str, allowed: Iterable | None) -> DataFrame:
    """Drop rows whose token array holds anything outside ``allowed``.

    A null token is outside; a null or empty array holds none.
    """
    if allowed is None:
        return df
    known = F.array(*[F.lit(t) for t in sorted(allowed)])
    element = df.schema[tokens].dataType.elementType
    known = known.cast(f"array<{element.simpleString()}>")
    inside = F.forall(tokens, lambda t: F.coalesce(F.array_contains(known, t), F.lit(False)))
    return df.where(F.coalesce(inside, F.lit(True)))


def restrict_long(
    df: DataFrame, tokens: DataFrame, keys: Sequence[str], token: str, allowed: Iterable | None
) -> DataFrame:
    """The same for tokens kept in a long table: one row per (key, token)."""
    if allowed is None:
        return df
    known = F.coalesce(F.col(token).isin(*sorted(allowed)), F.lit(False))
    foreign = tokens.where(~known).select(*keys).distinct()
    return hot_join(df, foreign, keys, "left_anti", repeats=True)


def sweep(
    spark: SparkSession,
    names: Sequence[str] = DEFAULT_SWEEP,
    root: str = ".",
    registry: Mapping[str, SourceSpec] = REGISTRY,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """Union of several datasets, labelled by name; absent columns are null."""
    unknown = [n for n in names if n not in registry]
    if unknown:
        raise KeyError(f"unknown dataset {unknown[0]!r}, expected one of {tuple(registry)}")
    frames = [load(spark, registry[n], root, tokens).withColumn("dataset", F.lit(n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compound_long(df: DataFrame, spec: SourceSpec, row_id: str = "row_id") -> DataFrame:
    """One row per molecule-valued cell: ``(row_id, role, key)``."""
    return df.unpivot([row_id], list(spec.compounds), "role", "key").where(F.col("key").isNotNull())


def distinct_compounds(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Every molecule that occurs, once, so that featurising runs once each."""
    cells = F.array(*[F.col(_quoted(c)) for c in spec.compounds])
    return df.select(F.explode(cells).alias("key")).where(F.col("key").isNotNull()).distinct()
