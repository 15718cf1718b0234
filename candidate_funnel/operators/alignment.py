"""Best RMSD of candidate pairs over atom mappings and rigid motion.

Mappings come as a product: orders of all atoms, times sets of atoms that may be
exchanged freely among themselves (the leaves of one node, say). A graph of 31,104
mappings is 24 orders and four sets of three. In a fixed frame the least distance
splits over the sets, so the product is never multiplied out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.functions.scalars import atom_radii, axis_sorted
from candidate_funnel.operators.neighbours import BLOCK_PAIRS, Gate, Metric, matrix, near_pairs, numbers, pair_rmsd, rmsd
from candidate_funnel.operators.neighbours import GROUP_LIMIT as PAIR_LIMIT
from candidate_funnel.session import cut

# Rows of a key (or block of one) per task under ``BestRmsd`` after the best motion:
# comparing takes some steps per pair and mapping, so tasks are smaller than for plain
# distances. Keys of the usual pool size (500) stay whole.
GROUP_LIMIT = 512

# Pairs measured at a time inside a task.
CHUNK_PAIRS = 8192

# Headroom of the index distance over the exact one, for rounding.
INDEX_SLACK = 1e-9

# Rows that all others of a task are measured against first, and how many pairs
# a row must have at least for that to pay.
PIVOTS = 6
PIVOT_PAIRS = 3

# Share of a block's pairs from which on matrix products over the whole block
# are cheaper than its pairs one by one.
DENSE = 1 / 16

# The largest overlap is taken from its quartic where the root is a simple one
# and the distance no small difference of large numbers; the decomposition does
# the rest. All three are relative, the last is the change a step may still make.
SIMPLE_ROOT = 1e-2
LEAST_REST = 1e-2
SETTLED = 1e-14
STEPS = 24

# Headroom of the bounds that spare pairs, for rounding.
SPARE_SLACK = 1e-9

# Sets of exchangeable atoms are matched over all their subsets.
LARGEST_SWAP = 14

# Orders of a key up to which it is checked that they form a group.
GROUP_ORDERS = 64


def moved_rmsd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """RMSD of each pair of centred structures after turning ``b`` onto ``a``.

    The rotation comes from a singular value decomposition (Kabsch 1976); its
    last axis is flipped where it would be a reflection. Distances are taken
    from the moved atoms, which keeps near-zero values accurate.
    """
    u, _, vt = np.linalg.svd(np.einsum("pni,pnj->pij", b, a))
    flip = np.ones((len(a), 1, 3))
    flip[:, 0, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    moved = b @ ((u * flip) @ vt)
    return np.sqrt(((a - moved) ** 2).sum(axis=(1, 2)) / a.shape[1])


def overlap_rmsd(
    h: np.ndarray,
    size_a: np.ndarray,
    size_b: np.ndarray,
    atoms: int,
    measure: Callable[[np.ndarray], np.ndarray],
) -> np.ndarray:
    """RMSD of pairs from their products of axes ``h`` (3, 3, P) and sums of squares.

    The overlap under the best rotation is the largest root of a quartic whose
    coefficients are the norm, the determinant and the cofactors of ``h`` (Horn
    1987, Theobald 2005). All its roots are real, so Newton's steps from a bound
    above go down to the largest one. ``measure`` takes the pairs (by number)
    for which that would lose digits.
    """
    norm = np.sqrt(np.einsum("ijp,ijp->p", h, h))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        (a, b, c), (d, e, f), (g, i, j) = h / norm
        rows = (e * j - f * i, f * g - d * j, d * i - e * g)
        minors = sum(m * m for m in rows)
        minors += sum(m * m for m in (b * j - c * i, a * j - c * g, a * i - b * g))
        minors += sum(m * m for m in (b * f - c * e, a * f - c * d, a * e - b * d))
        slope = -8.0 * (a * rows[0] + b * rows[1] + c * rows[2])
        start = 1.0 - 4.0 * minors
        root = np.full(h.shape[2], np.sqrt(3.0))
        for _ in range(STEPS):
            square = root * root
            rise = 4.0 * root * (square - 1.0) + slope
            change = ((square - 2.0) * square + slope * root + start) / rise
            root -= change
            if not (np.abs(change) > SETTLED).any():
                break
        whole = size_a + size_b
        rest = whole - 2.0 * norm * root
        # Written so that what is no number is measured, too.
        safe = (rise > SIMPLE_ROOT) & (np.abs(change) <= SETTLED) & (rest > LEAST_REST * whole)
        out = np.sqrt(rest / atoms)
    doubtful = np.nonzero(~safe)[0]
    if len(doubtful):
        out[doubtful] = measure(doubtful)
    return out


def aligned_rmsd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """RMSD of each pair after moving ``b`` onto ``a``; shapes (P, N, 3)."""
    a = a - a.mean(axis=1, keepdims=True)
    b = b - b.mean(axis=1, keepdims=True)
    h = (a.transpose(0, 2, 1) @ b).transpose(1, 2, 0)
    size_a, size_b = (np.einsum("pni,pni->p", v, v) for v in (a, b))
    return overlap_rmsd(h, size_a, size_b, a.shape[1], lambda at: moved_rmsd(a[at], b[at]))


@dataclass(frozen=True)
class Orders:
    """The mappings of one key: ``perms`` (one order per row) times free ``swaps``."""

    perms: np.ndarray
    swaps: tuple[np.ndarray, ...] = ()

    @staticmethod
    def of(symmetry: pa.Table | None, atoms: int) -> Orders:
        """From the packed row of a key; keys without one have the identity."""
        identity = np.arange(atoms)[None, :]
        if symmetry is None or not symmetry.num_rows:
            return Orders(identity)
        listed = symmetry["_perms"][0].as_py() or identity.tolist()
        swaps = tuple(np.array(b) for b in symmetry["_swaps"][0].as_py() or () if len(b) > 1)
        if any(len(p) != atoms for p in listed) or max(map(max, listed)) >= atoms:
            raise ValueError("mappings number other atoms than the metric has")
        if any(b.max() >= atoms for b in swaps):
            raise ValueError("exchangeable atoms lie beyond those of the metric")
        if any(len(b) > LARGEST_SWAP for b in swaps):
            raise ValueError(f"more than {LARGEST_SWAP} atoms may be exchanged at once")
        return Orders(np.array(listed, dtype=np.int64), swaps)

    def each(self) -> Iterator[np.ndarray]:
        """Every mapping of the product, one at a time."""
        for perm in self.perms:
            for chosen in product(*(permutations(b.tolist()) for b in self.swaps)):
                order = np.arange(len(perm))
                for own, other in zip(self.swaps, chosen, strict=True):
                    order[own] = other
                yield perm[order]

    def closed(self) -> bool:
        """Whether the mappings are known to form a group, so distances are a metric."""
        if len(self.perms) > GROUP_ORDERS:
            return False
        known = {tuple(p) for p in self.perms.tolist()}
        sets = {frozenset(b.tolist()) for b in self.swaps}
        return all(tuple(p[q]) in known for p in self.perms for q in self.perms) and all(
            frozenset(p[b].tolist()) in sets for p in self.perms for b in self.swaps
        )


def matched(cost: np.ndarray) -> np.ndarray:
    """Least cost of matching rows with columns; costs have shape (P, k, k)."""
    k = cost.shape[1]
    best = {0: np.zeros(len(cost))}
    for row in range(k):
        grown: dict[int, np.ndarray] = {}
        for used, total in best.items():
            for column in range(k):
                if not used >> column & 1:
                    with_it = total + cost[:, row, column]
                    key = used | 1 << column
                    grown[key] = np.minimum(grown[key], with_it) if key in grown else with_it
        best = grown
    return best[(1 << k) - 1]


def fixed_rmsd(a: np.ndarray, b: np.ndarray, swaps: Sequence[np.ndarray]) -> np.ndarray:
    """Fixed-frame RMSD of each pair, sets of exchangeable atoms matched at their best."""
    square = (a - b) ** 2
    total = square.sum(axis=(1, 2))
    for own in swaps:
        x, y = a[:, own], b[:, own]
        total -= square[:, own].sum(axis=(1, 2))
        total += matched(((x[:, :, None] - y[:, None, :]) ** 2).sum(axis=3))
    return np.sqrt(np.maximum(total, 0.0) / a.shape[1])


def distances(
    a: np.ndarray, b: np.ndarray, orders: Orders, align: bool
) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """For each mapping, a function from pair numbers to their RMSD under it."""
    if align:
        for order in orders.each():
            yield lambda at, order=order: aligned_rmsd(a[at], b[at][:, order])
    else:
        for perm in orders.perms:
            yield lambda at, perm=perm: fixed_rmsd(a[at], b[at][:, perm], orders.swaps)


def best_rmsd(a: np.ndarray, b: np.ndarray, orders: Orders, align: bool) -> np.ndarray:
    """Smallest RMSD of each pair over the mappings of the second structure."""
    best = np.full(len(a), np.inf)
    for at in chunks(len(a)):
        for distance in distances(a, b, orders, align):
            best[at] = np.minimum(best[at], distance(at))
    return best


def block_rmsd(
    x: np.ndarray, y: np.ndarray, orders: Orders, align: bool, near: np.ndarray, limit: float
) -> np.ndarray:
    """Best RMSD of the ``near`` pairs of rows of ``x`` and ``y``, as a matrix.

    Pairs that are not near or that a bound shows to be out of the ``limit`` stay
    at infinity. Bounds come from matrix products over the whole block.
    """
    best = np.full(near.shape, np.inf)
    if near.mean() < DENSE or (orders.swaps and not align):
        i, j = np.nonzero(near)
        for at in chunks(len(i)):
            best[i[at], j[at]] = best_rmsd(x[i[at]], y[j[at]], orders, align)
    elif align:
        _turned(x, y, orders, near, limit, best)
    else:
        _fixed(x, y, orders, near, limit, best)
    return best


def _turned(
    x: np.ndarray, y: np.ndarray, orders: Orders, near: np.ndarray, limit: float, best: np.ndarray
) -> None:
    """Distances after the best motion, put into ``best``.

    No overlap exceeds the square root of three times the norm of the products
    of axes, which settles most pairs that are out of range.
    """
    atoms = x.shape[1]
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    size_x, size_y = (np.einsum("pni,pni->p", v, v) for v in (x, y))
    room = atoms * limit**2 * (1 + SPARE_SLACK)
    # Twice the overlap that a pair in range has at least.
    needed = np.maximum((size_x - room)[:, None] + size_y[None, :], 0.0) ** 2
    needed *= (1 - SPARE_SLACK) / 12.0
    axes = np.ascontiguousarray(x.transpose(2, 0, 1))[:, None]
    for order in orders.each():
        turned = y[:, order]
        h = axes @ np.ascontiguousarray(turned.transpose(2, 1, 0))[None]
        i, j = np.nonzero(near & (np.einsum("ijkl,ijkl->kl", h, h) >= needed))
        if len(i):
            dist = overlap_rmsd(
                h[:, :, i, j], size_x[i], size_y[j], atoms, lambda at: moved_rmsd(x[i[at]], turned[j[at]])
            )
            best[i, j] = np.minimum(best[i, j], dist)


def _fixed(
    x: np.ndarray, y: np.ndarray, orders: Orders, near: np.ndarray, limit: float, best: np.ndarray
) -> None:
    """Distances in a fixed frame, put into ``best``.

    Products tell which pairs a mapping may bring into range, and nearer than the
    mappings before; those are measured from their differences.
    """
    atoms = x.shape[1]
    # One origin for all atoms, so that no mapping moves it.
    origin = x.mean(axis=(0, 1))
    # The differences are those of the given values.
    given, centred, others = x.reshape(len(x), -1), (x - origin).reshape(len(x), -1), y - origin
    square_x, square_y = (centred * centred).sum(axis=1), (others * others).sum(axis=(1, 2))
    doubt = SPARE_SLACK * (atoms * limit**2 + square_x.max(initial=0.0) + square_y.max(initial=0.0))
    room = np.where(near, atoms * limit**2 + doubt, -np.inf)
    for perm in orders.perms:
        turned = y[:, perm].reshape(len(y), -1)
        apart = centred @ others[:, perm].reshape(len(y), -1).T
        apart *= -2.0
        apart += square_x[:, None]
        apart += square_y[None, :]
        i, j = np.nonzero(apart <= room)
        dist = rmsd(given, turned, i, j, x.shape[2])
        best[i, j] = np.minimum(best[i, j], dist)
        room[i, j] = np.minimum(room[i, j], atoms * dist**2 + doubt)


def chunks(n: int) -> Iterator[np.ndarray]:
    for start in range(0, n, CHUNK_PAIRS):
        yield np.arange(start, min(start + CHUNK_PAIRS, n))


def any_in_range(a: np.ndarray, b: np.ndarray, orders: Orders, align: bool, gate: Gate) -> np.ndarray:
    """Whether some mapping brings a pair into range; no more are tried then."""
    found = np.zeros(len(a), dtype=bool)
    for at in chunks(len(a)):
        for distance in distances(a, b, orders, align):
            dist = distance(at)
            hit = dist < gate.rmsd if gate.strict else dist <= gate.rmsd
            found[at[hit]] = True
            at = at[~hit]
            if not len(at):
                break
    return found


def in_range(x: np.ndarray, i: np.ndarray, j: np.ndarray, orders: Orders, align: bool, gate: Gate) -> np.ndarray:
    """Which pairs of rows of ``x`` are in range of each other.

    Where rows have many pairs and the distance is a metric, all rows are first
    measured against a few pivots. A pair whose distances to some pivot differ
    by more than the limit is out of range, one whose distances add up to less
    is in range; only the rest is measured.
    """
    near = np.zeros(len(i), dtype=bool)
    open_pairs = np.arange(len(i))
    rows = np.unique(np.concatenate([i, j]))
    if len(i) > PIVOT_PAIRS * PIVOTS * len(rows) and orders.closed():
        slack = 1e-9 * (1.0 + gate.rmsd)
        least = np.full(len(x), np.inf)
        pivot = rows[0]
        low, high = np.zeros(len(i)), np.full(len(i), np.inf)
        for _ in range(PIVOTS):
            away = np.full(len(x), np.inf)
            away[rows] = best_rmsd(np.broadcast_to(x[pivot], x[rows].shape), x[rows], orders, align)
            np.maximum(low, np.abs(away[i] - away[j]), out=low)
            np.minimum(high, away[i] + away[j], out=high)
            np.minimum(least, away, out=least)
            pivot = rows[int(np.argmax(least[rows]))]
        near = high < gate.rmsd - slack
        open_pairs = np.nonzero(~near & (low <= gate.rmsd + slack))[0]
    near[open_pairs] = any_in_range(x[i[open_pairs]], x[j[open_pairs]], orders, align, gate)
    return near


def _matched_first(x: np.ndarray, swaps: Sequence[np.ndarray]) -> np.ndarray:
    """Flat structures, the values of exchangeable atoms in order on each axis.

    Such structures are as far apart as at the best match if atoms have one value,
    and never further.
    """
    x = x.copy()
    for own in swaps:
        x[:, own] = np.sort(x[:, own], axis=1)
    return x.reshape(len(x), -1)


def fixed_range(
    x: np.ndarray, y: np.ndarray, orders: Orders, near: np.ndarray, gate: Gate
) -> tuple[np.ndarray, np.ndarray]:
    """Which ``near`` pairs of rows are in range in a fixed frame, and which to measure.

    One matrix product per mapping tells; pairs close to the limit are to be
    measured, and with exchangeable atoms of several values all that may be in range.
    """
    atoms, dims = x.shape[1:]
    # One origin for all atoms, so that no mapping moves it.
    origin = x.mean(axis=(0, 1))
    x, y = x - origin, y - origin
    left = _matched_first(x, orders.swaps)
    square_x, square_y = ((v * v).sum(axis=(1, 2)) for v in (x, y))
    room = atoms * gate.rmsd**2
    doubt = SPARE_SLACK * (room + square_x.max(initial=0.0) + square_y.max(initial=0.0))
    known = dims == 1 or not orders.swaps
    step = max(1, BLOCK_PAIRS // max(1, len(y)))
    sure, open_pairs = np.zeros(near.shape, dtype=bool), np.zeros(near.shape, dtype=bool)
    for perm in orders.perms:
        right = _matched_first(y[:, perm], orders.swaps).T
        for start in range(0, len(x), step):
            rows = slice(start, start + step)
            apart = left[rows] @ right
            apart *= -2.0
            apart += square_x[rows, None]
            apart += square_y[None, :]
            if known:
                sure[rows] |= apart < room - doubt
            open_pairs[rows] |= apart <= room + doubt
    return sure & near, open_pairs & near & ~sure


def pack_symmetry(
    keys: Sequence[str], mappings: DataFrame | None = None, swaps: DataFrame | None = None
) -> DataFrame | None:
    """(keys, _perms, _swaps): one row per key with mappings.

    ``mappings(keys, perm)`` lists atom orders, ``swaps(keys, block)`` sets of
    atoms that may be exchanged freely besides. Their number per key is bounded
    by the symmetry guard, not by the candidates.
    """
    keys = list(keys)
    if mappings is None and swaps is None:
        return None
    parts = []
    for df, column, name in ((mappings, "perm", "_perms"), (swaps, "block", "_swaps")):
        if df is not None:
            parts.append(df.groupBy(*keys).agg(F.collect_list(F.col(column).cast("array<int>")).alias(name)))
    packed = parts[0] if len(parts) == 1 else parts[0].join(parts[1], keys, "full")
    for name in ("_perms", "_swaps"):
        if name not in packed.columns:
            packed = packed.withColumn(name, F.array().cast("array<array<int>>"))
    return packed.select(*keys, "_perms", "_swaps")


def fits(atoms: Column) -> Column:
    """Whether a packed row numbers exactly the given atoms; none fits always."""
    whole = F.sequence(F.lit(0), atoms.cast("int") - 1)
    perms = F.coalesce(F.col("_perms"), F.array().cast("array<array<int>>"))
    blocks = F.coalesce(F.col("_swaps"), F.array().cast("array<array<int>>"))
    return F.forall(perms, lambda p: F.array_sort(p) == whole) & F.forall(
        blocks, lambda b: F.forall(b, lambda x: (x >= 0) & (x < atoms)) & (F.size(b) <= LARGEST_SWAP)
    )


@dataclass(frozen=True)
class BestRmsd(Metric):
    """Best RMSD as the distance of de-duplication and clusters.

    ``symmetry`` comes from ``pack_symmetry``. An index distance that never
    exceeds the best RMSD finds the pairs worth measuring.
    """

    coords: str = "coords"
    dims: int = 3
    align: bool = True
    symmetry: DataFrame | None = None
    group_limit: int | None = None

    def __post_init__(self) -> None:
        if self.align and self.dims != 3:
            raise ValueError("alignment needs three values per atom")
        if self.group_limit is None:
            # In a fixed frame, matrix products compare whole blocks.
            object.__setattr__(self, "group_limit", GROUP_LIMIT if self.align else PAIR_LIMIT)

    def index(self) -> Column:
        return (atom_radii if self.align else axis_sorted)(self.coords, self.dims)

    def index_gate(self, gate: Gate) -> Gate:
        limit = gate.rmsd * (1 + INDEX_SLACK) + INDEX_SLACK
        return replace(gate, rmsd=limit, strict=False, dims=1 if self.align else self.dims)

    def within(
        self, a: pa.Table, b: pa.Table, near: np.ndarray, same: bool, gate: Gate, symmetry: pa.Table | None
    ) -> np.ndarray:
        rows = [a] if same else [a, b]
        x = np.concatenate([matrix(t[self.coords]) for t in rows])
        x = x.reshape(len(x), -1, self.dims)
        pos = np.concatenate([numbers(t["pos"]) for t in rows])
        out = np.zeros_like(near)
        orders = Orders.of(symmetry, x.shape[1])
        near = np.triu(near, 1) if same else near
        if not self.align and near.mean() >= DENSE:
            out, near = self._told(x[: a.num_rows], x[-b.num_rows :], pos, orders, near, gate)
        i, j = np.nonzero(near)
        right = j if same else j + a.num_rows
        # A pair is measured the same way round whichever task meets it.
        turned = pos[i] > pos[right]
        first, second = np.where(turned, right, i), np.where(turned, i, right)
        out[i, j] = in_range(x, first, second, orders, self.align, gate)
        if same:
            out |= out.T
            np.fill_diagonal(out, True)
        return out

    def _told(
        self, x: np.ndarray, y: np.ndarray, pos: np.ndarray, orders: Orders, near: np.ndarray, gate: Gate
    ) -> tuple[np.ndarray, np.ndarray]:
        """``fixed_range`` of pairs whose later row is the mapped one."""
        if orders.closed():
            # The inverse of every mapping is one, too.
            return fixed_range(x, y, orders, near, gate)
        turned = pos[: len(x), None] > pos[None, -len(y) :]
        sure, open_pairs = fixed_range(x, y, orders, near & ~turned, gate)
        others = fixed_range(y, x, orders, (near & turned).T, gate)
        return sure | others[0].T, open_pairs | others[1].T


def pair_best_rmsd(
    df: DataFrame,
    keys: Sequence[str],
    max_dist: float,
    mappings: DataFrame | None = None,
    align: bool = True,
    ident: str = "cand_id",
    coords: str = "coords",
    dims: int = 3,
    bound: int | None = None,
    group_limit: int = PAIR_LIMIT,
    swaps: DataFrame | None = None,
) -> DataFrame:
    """Pairs ``(keys, a, b, dist)``, ``a < b``, whose best RMSD is in range.

    ``mappings(keys, mapping_id, perm)`` lists atom orders (from 0) under
    which a structure is the same; keys without any use the identity.
    ``swaps(keys, block)`` lists sets of atoms that may be exchanged freely
    besides. Clusters and de-duplication need no such rows (``BestRmsd``).
    """
    keys = list(keys)
    if align and dims != 3:
        raise ValueError("alignment needs three values per atom")
    if mappings is None and swaps is None and not align:
        return pair_rmsd(df, keys, ident, coords, max_dist, dims, bound)
    metric = BestRmsd(coords, dims, align, pack_symmetry(keys, mappings, swaps))

    def measure(a: pa.Table, b: pa.Table, symmetry: pa.Table | None) -> Callable:
        x, y = (matrix(t[coords]).reshape(t.num_rows, -1, dims) for t in (a, b))
        orders = Orders.of(symmetry, x.shape[1])

        def block(rows: slice, columns: slice, near: np.ndarray) -> np.ndarray:
            return block_rmsd(x[rows], y[columns], orders, align, near, max_dist)

        return block

    # Written out: sizes, cells and tiles all read the index, which is dear to work out.
    rows = cut(df.select(*keys, ident, coords, metric.index().alias("_index")))
    gate = metric.index_gate(Gate(max_dist, dims=dims))
    return near_pairs(
        rows, keys, ident, "_index", gate, measure, max_dist, metric.symmetry, bound, group_limit
    )
