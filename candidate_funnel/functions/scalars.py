"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact 2019 SI conversions and the block names of the
# ensemble statistics, which results must agree on.
EV_TO_KCAL = 23.06054783061903
BOLTZMANN_EV_PER_K = 8.617333262e-5
STATISTICS = ("min", "max", "mean", "std")
AGGREGATIONS = ("lowest", "boltzmann", "ensemble_stats")

# Default parameters.
DEFAULTS = {
    "per_unit": 50,
    "max_pool": 500,
    "seed": 0xF00D,
    "prune_rmsd": 0.5,
    "window": 10.0,
    "cluster_rmsd": 0.3,
    "max_mappings": 5000,
    "max_selected": 20,
    "dedup_score": 0.1,
    "dedup_rmsd": 0.125,
    "max_final": 20,
    "temperature": 298.15,
    "aggregation": "lowest",
    "radius": 2,
    "n_bits": 2048,
}


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def budget(units: str | Column, per_unit: int = 50, cap: int = 500) -> Column:
    """Pool size of a key: ``per_unit`` for each unit plus one, capped."""
    return F.least(F.lit(per_unit) * (column(units) + 1), F.lit(cap))


def squared_norm(vec: str | Column) -> Column:
    return F.aggregate(column(vec), F.lit(0.0), lambda total, x: total + x * x)


def finite(vec: str | Column) -> Column:
    """Whether a vector is there and all its values are finite numbers."""
    ok = F.forall(column(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def dot_sum(vec: str | Column) -> Column:
    return F.aggregate(column(vec), F.lit(0.0), lambda total, x: total + x)


def axis_values(coords: str | Column, dims: int, axis: int) -> Column:
    """Every value of one axis of coordinates flattened atom by atom."""
    return F.filter(column(coords), lambda _, i: i % dims == axis)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time per row.

    An expression that a lambda refers to directly runs again per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def centred(coords: str | Column, dims: int) -> Column:
    """Subtract the centroid from coordinates flattened atom by atom."""
    atoms = F.size(column(coords)) / dims
    means = F.array(*[dot_sum(axis_values(coords, dims, axis)) / atoms for axis in range(dims)])
    return once(
        means,
        lambda m: F.transform(column(coords), lambda x, i: x - F.get(m, (i % dims).cast("int"))),
    )


def atom_radii(coords: str | Column, dims: int) -> Column:
    """Sorted distances of the atoms to their centroid.

    Rotations, shifts and relabelled atoms leave it unchanged, and between two
    structures the distance of these vectors never exceeds that of the aligned
    coordinates, so it is a safe index for the best-RMSD search.
    """
    starts = F.sequence(F.lit(1), F.size(column(coords)) - dims + 1, F.lit(dims))
    radii = once(
        centred(coords, dims),
        lambda flat: F.transform(starts, lambda at: F.sqrt(squared_norm(F.slice(flat, at, dims)))),
    )
    return F.array_sort(radii)


def axis_sorted(coords: str | Column, dims: int) -> Column:
    """Coordinate values sorted axis by axis: the same bound without rotation."""
    return F.concat(
        *[F.array_sort(axis_values(coords, dims, axis)) for axis in range(dims)]
    )
