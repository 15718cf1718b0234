"""Which candidates of a key lie within a distance of each other.

Small keys are compared inside one group. A key too large for that is cut into
cells by values that can differ no more than the distance itself (vector norm,
the key's principal directions and, where there is a score gate, the score), so
only touching cells can hold neighbours; crowded cells are cut again into blocks. Every pair
of touching blocks is one bounded task, and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidate_funnel.functions.scalars import finite, squared_norm
from candidate_funnel.operators.skew import find_hot, hot_join, keyed, largest_group, parts_for, shuffled
from candidate_funnel.session import cut

# Rows of one key (or one block of a large key) that a single task compares.
GROUP_LIMIT = 2048

# Pairs whose differences are held at a time: few enough to stay in a core's cache.
SLICE_PAIRS = 2048

# Pairs of a tile that are looked at together; some matrices of them are held.
BLOCK_PAIRS = 131_072

# Tiles of pairs that a task sorts at a time; a tile holds two blocks at most.
TASK_TILES = 32

# Factors by which thinly filled cells are merged.
MERGES = (1, 2, 4, 8, 16, 32, 64)

# Rows of a region that one task works off by itself, and widths of regions in cells.
REGION_ROWS = 2048
WIDENINGS = tuple(1 << k for k in range(13))

# Principal directions whose values place rows in cells, and how many coordinates
# they may use: of longer vectors, as many at even steps.
AXES = 2
AXIS_COORDS = 256
# Keys whose moments a task adds up before it sends them on, and partial sums of
# a key that meet in one place at a time.
HELD_KEYS = 64
SUM_PARTS = 64

# Widening of a cell that keeps rounding from separating true neighbours.
CELL_SLACK = 1.001

AGGREGATES = {"min": F.min, "max": F.max, "sum": F.sum}
FOLDS = {
    "min": (np.min, np.iinfo(np.int64).max),
    "max": (np.max, np.iinfo(np.int64).min),
    "sum": (np.sum, 0),
}


@dataclass(frozen=True)
class Gate:
    """When two candidates are alike.

    ``rmsd`` bounds the root mean square distance over atoms of ``dims``
    values each, strictly if ``strict``. ``score`` adds a strict bound on the
    score difference.
    """

    rmsd: float
    strict: bool = False
    score: float | None = None
    dims: int = 1

    @property
    def lanes(self) -> int:
        """Values that place a row in a cell: its norm, directions, and its score."""
        return 1 + AXES + (self.score is not None)


def matrix(values: pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a float matrix; others are an error, not a mix-up."""
    lengths = pa.compute.list_value_length(values)
    if lengths.null_count or (len(values) and len(lengths.unique()) > 1):
        raise ValueError("the vectors of a key differ in length or are missing")
    flat = values.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(values), -1)


def numbers(values: pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy()


def rmsd(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, dims: int) -> np.ndarray:
    """Fixed-frame RMSD of the listed pairs of rows, a slice at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), SLICE_PAIRS):
        part = slice(at, at + SLICE_PAIRS)
        apart = a[i[part]]
        apart -= b[j[part]]
        apart *= apart
        out[part] = apart.sum(axis=1)
    return np.sqrt(out / (a.shape[1] / dims))


def alike(
    a: np.ndarray,
    b: np.ndarray,
    gate: Gate,
    score_a: np.ndarray | None = None,
    score_b: np.ndarray | None = None,
) -> np.ndarray:
    """Boolean matrix of the pairs that pass the gate.

    A matrix product decides the clear cases; the few close to the threshold
    are measured again from the differences.
    """
    # Distances do not change with the origin; a near one keeps digits.
    x, y = a - a.mean(axis=0), b - a.mean(axis=0)
    square_a, square_b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    apart = square_a[:, None] + square_b[None, :] - 2.0 * (x @ y.T)
    limit = gate.rmsd**2 * (a.shape[1] / gate.dims)
    doubt = 1e-9 * (limit + square_a.max(initial=0.0) + square_b.max(initial=0.0))
    near = apart <= limit
    i, j = np.nonzero(np.abs(apart - limit) <= doubt)
    if len(i):
        measured = rmsd(a, b, i, j, gate.dims)
        near[i, j] = measured < gate.rmsd if gate.strict else measured <= gate.rmsd
    if gate.score is not None:
        near &= np.abs(score_a[:, None] - score_b[None, :]) < gate.score
    return near


def split_by_size(
    df: DataFrame, keys: Sequence[str], limit: int, bound: int | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Separate the keys of at most ``limit`` rows from the larger ones.

    ``bound`` is a row count per key the caller has already enforced. A null
    key is none; its rows are in neither part, whatever their number.
    """
    df = keyed(df, keys)
    if bound is not None and bound <= limit:
        return df, None
    if largest_group(df, keys) <= limit:
        return df, None
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = cut(counts.where(F.col("_n") > limit).drop("_n"))
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")


def structures(
    df: DataFrame, keys: Sequence[str], ident: str, coords: str = "coords"
) -> DataFrame:
    """Exact copies collapsed: lowest id, coordinates and number of copies ``n``."""
    return df.groupBy(*keys, coords).agg(F.min(ident).alias(ident), F.count("*").alias("n"))


def _moments(keys: list[str], coords: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number, sum and outer products of each key's vectors, added up inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent() -> pa.RecordBatch:
            columns = [pa.array([k[n] for k in held], types[n]) for n in range(len(keys))]
            sums = list(held.values())
            columns.append(pa.array([v[0] for v in sums], pa.int64()))
            columns += [pa.array([v[n].ravel() for v in sums], pa.list_(pa.float64())) for n in (1, 2)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "_n", "_sum", "_outer"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            types = [table.schema.field(k).type for k in keys]
            rows: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*(table[k].to_pylist() for k in keys), strict=True)):
                rows.setdefault(key, []).append(at)
            for key, own in rows.items():
                x = spaced(matrix(table[coords].take(pa.array(own))))
                n, total, outer = held.get(key, (0, 0.0, 0.0))
                held[key] = [n + len(x), total + x.sum(axis=0), outer + x.T @ x]
                if len(held) >= HELD_KEYS:
                    yield sent()
        if held:
            yield sent()

    return run


def spaced(x: np.ndarray) -> np.ndarray:
    """At most ``AXIS_COORDS`` columns at even steps."""
    return x if x.shape[1] <= AXIS_COORDS else x[:, spaced_at(x.shape[1])]


def spaced_at(width: int) -> np.ndarray:
    if width <= AXIS_COORDS:
        return np.arange(width)
    return np.floor(np.arange(AXIS_COORDS) * ((width - 1) / (AXIS_COORDS - 1.0))).astype(np.int64)


def directions(df: DataFrame, keys: Sequence[str], coords: str) -> DataFrame:
    """(keys, _axes): the ``AXES`` directions along which a key's vectors differ most.

    They come from second moments over all rows, added up inside tasks first.
    Being orthonormal, no direction shows two rows further apart than they are,
    so cells by them lose no neighbour, whatever the vectors.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    sums = T.StructType(
        [
            *key_fields,
            T.StructField("_n", T.LongType()),
            *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_sum", "_outer")],
        ]
    )
    parts = df.select(*keys, coords).mapInArrow(_moments(keys, coords), sums)

    def added(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        return sum(numbers(table["_n"]).tolist()), matrix(table["_sum"]).sum(axis=0), matrix(table["_outer"]).sum(axis=0)

    def add(table: pa.Table) -> pa.Table:
        n, total, outer = added(table)
        columns = {k: table[k].slice(0, 1) for k in keys}
        columns |= {"_n": pa.array([n], pa.int64())}
        columns |= {c: pa.array([v], pa.list_(pa.float64())) for c, v in (("_sum", total), ("_outer", outer))}
        return pa.table(columns)

    def solve(table: pa.Table) -> pa.Table:
        n, total, outer = added(table)
        width = len(total)
        spread = outer.reshape(width, width) / n - np.outer(total, total) / n**2
        axes = np.zeros((AXES, width))
        found = np.linalg.eigh(spread)[1][:, ::-1][:, :AXES].T
        axes[: len(found)] = found
        columns = {k: table[k].slice(0, 1) for k in keys}
        return pa.table({**columns, "_axes": pa.array([axes.tolist()], pa.list_(pa.list_(pa.float64())))})

    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SUM_PARTS)))
    once = salted.groupBy(*keys, "_salt").applyInArrow(add, sums)
    schema = T.StructType([*key_fields, T.StructField("_axes", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return once.groupBy(*keys).applyInArrow(solve, schema)


def _lanes(gate: Gate, coords: str, score: str | None) -> Column:
    atoms = F.size(coords) / gate.dims
    width = F.lit(gate.rmsd * CELL_SLACK) * F.sqrt(atoms)
    # The coordinates that directions use, as ``spaced`` picks them.
    n = F.size(coords)
    used = F.when(n <= AXIS_COORDS, F.col(coords)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(AXIS_COORDS - 1)),
            lambda k: F.get(F.col(coords), F.floor(k * ((n - 1) / F.lit(AXIS_COORDS - 1.0))).cast("int")),
        )
    )
    lanes = [F.sqrt(squared_norm(coords)) / width]
    for axis in range(AXES):
        products = F.zip_with(used, F.get("_axes", F.lit(axis)), lambda x, u: x * u)
        lanes.append(F.aggregate(products, F.lit(0.0), lambda total, x: total + x) / width)
    if gate.score is not None:
        lanes.append(F.col(score) / F.lit(gate.score * CELL_SLACK))
    return F.array(*[F.floor(lane).cast("bigint") for lane in lanes])


def with_cells(
    df: DataFrame,
    keys: Sequence[str],
    gate: Gate,
    coords: str,
    score: str | None = None,
    block_rows: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``_cell``: rows in range of each other lie in touching cells.

    Cells start as wide as the gate. Where that would leave a key with many
    nearly empty ones, all its cells are merged by the smallest power of two
    that fills them.
    """
    keys = list(keys)
    # Written out: a second run could add the moments in another order.
    axes = cut(directions(df, keys, coords))
    fine = hot_join(df, axes, keys).withColumn("_lane", _lanes(gate, coords, score)).drop("_axes")

    def merged(factor: int | Column) -> Column:
        return F.transform("_lane", lambda x: F.floor(x / factor).cast("bigint"))

    occupied = [F.approx_count_distinct(merged(f)).alias(f"_at{f}") for f in MERGES]
    filled = [
        F.when(F.col("_n") >= F.col(f"_at{f}") * (block_rows / 8), F.lit(f)) for f in MERGES
    ]
    factors = (
        fine.groupBy(*keys)
        .agg(F.count("*").alias("_n"), *occupied)
        .select(*keys, F.coalesce(*filled, F.lit(MERGES[-1])).alias("_factor"))
    )
    placed = hot_join(fine, factors, keys).withColumn("_cell", merged(F.col("_factor")))
    return placed.drop("_lane", "_factor")


def _cells(placed: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    blocks = F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks")
    return placed.groupBy(*keys, "_cell").agg(blocks)


def touching_cells(
    df: DataFrame, keys: Sequence[str], lanes: int, block_rows: int, against: DataFrame | None = None
) -> DataFrame:
    """(keys, _cell_a, _cell_b, _blocks_a, _blocks_b): cells that may hold neighbours."""
    keys = list(keys)
    itself = against is None
    steps = [s for s in product((-1, 0, 1), repeat=lanes) if not itself or s >= (0,) * lanes]
    moves = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in s]) for s in steps])
    shifted = F.transform(moves, lambda s: F.zip_with("_cell_a", s, lambda x, y: x + y))
    return (
        _cells(df, keys, block_rows)
        .withColumnsRenamed({"_cell": "_cell_a", "_blocks": "_blocks_a"})
        .withColumn("_cell_b", F.explode(shifted))
        .join(
            shuffled(
                _cells(df if itself else against, keys, block_rows).withColumnsRenamed(
                    {"_cell": "_cell_b", "_blocks": "_blocks_b"}
                )
            ),
            [*keys, "_cell_b"],
        )
    )


def tile_names(touching: DataFrame, keys: Sequence[str], itself: bool) -> DataFrame:
    """(keys, tile): the tiles of ``touching`` cells, from the cells alone."""
    named = touching.withColumn(
        "_block_a", F.explode(F.sequence(F.lit(0), F.col("_blocks_a") - 1))
    ).withColumn("_block_b", F.explode(F.sequence(F.lit(0), F.col("_blocks_b") - 1)))
    if itself:
        named = named.where(
            (F.col("_cell_a") != F.col("_cell_b")) | (F.col("_block_a") <= F.col("_block_b"))
        )
    return named.select(*keys, *TILE)


def tiles(
    df: DataFrame,
    keys: Sequence[str],
    ident: str,
    lanes: int,
    block_rows: int = GROUP_LIMIT,
    against: DataFrame | None = None,
) -> DataFrame:
    """Copy each row to every tile that may hold a neighbour of it.

    Rows carry the ``_cell`` of ``with_cells``, which has ``lanes`` values.
    Adds ``_cell_a, _block_a, _cell_b, _block_b`` naming the tile and
    ``_side``: 0 or 1, or 2 for both sides of a block compared with itself.
    With ``against``, only tiles between rows of ``df`` (side 0) and of the
    other table (side 1) are made.
    """
    keys = list(keys)
    itself = against is None
    placed_a, placed_b = df, df if itself else against
    touching = touching_cells(df, keys, lanes, block_rows, against)

    def side(cell: str, own: str, other: str, first: bool) -> DataFrame:
        return touching.select(
            *keys,
            F.col(cell).alias("_cell"),
            "_cell_a",
            "_cell_b",
            F.lit(first).alias("_first"),
            F.col(own).alias("_own"),
            F.col(other).alias("_other"),
        )

    side_a = side("_cell_a", "_blocks_a", "_blocks_b", True)
    side_b = side("_cell_b", "_blocks_b", "_blocks_a", False)
    if itself:
        outer = side_b.where(F.col("_cell_a") != F.col("_cell_b"))
        member = hot_join(placed_a, side_a.unionByName(outer), [*keys, "_cell"], grows=True)
        inner = F.col("_cell_a") == F.col("_cell_b")
    else:
        member = hot_join(placed_a, side_a, [*keys, "_cell"], grows=True).unionByName(
            hot_join(placed_b, side_b, [*keys, "_cell"], grows=True)
        )
        inner = F.lit(False)
    own, other, leads = F.col("_block"), F.col("_partner"), F.col("_first")
    return (
        member.withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_own")).cast("int"))
        .withColumn("_partner", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        .withColumn(
            "_block_a", F.when(inner, F.least(own, other)).when(leads, own).otherwise(other)
        )
        .withColumn(
            "_block_b", F.when(inner, F.greatest(own, other)).when(leads, other).otherwise(own)
        )
        .withColumn(
            "_side",
            F.when(inner & (own == other), 2)
            .when(inner, F.when(own < other, 0).otherwise(1))
            .otherwise(F.when(leads, 0).otherwise(1)),
        )
        .drop("_cell", "_first", "_own", "_other", "_block", "_partner")
    )


TILE = ["_cell_a", "_block_a", "_cell_b", "_block_b"]


def dealt(spread: DataFrame, touching: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles over as many partitions as it takes for ``TASK_TILES`` or fewer in each."""
    number = touching.agg(F.sum(F.col("_blocks_a").cast("bigint") * F.col("_blocks_b"))).first()[0]
    parts = parts_for(spread, number or 0, TASK_TILES)
    return spread.repartition(parts, *keys, *TILE) if parts else spread


def _sides(table: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    side = numbers(table["_side"])
    if (side == 2).all():
        return table, table, True
    return table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)), False


def _scores(table: pa.Table, score: str | None) -> np.ndarray | None:
    return numbers(table[score]) if score else None


class Metric:
    """A distance that tasks measure themselves, found through an index.

    ``index`` vectors of rows in range of each other pass ``index_gate``.
    ``symmetry`` holds one row per key that tasks need to measure, or is None.
    """

    coords: str
    symmetry: DataFrame | None
    group_limit: int = GROUP_LIMIT

    def __getstate__(self) -> dict:
        # Tasks get the rows they need; the table stays on the driver.
        return {**self.__dict__, "symmetry": None}

    def index(self) -> Column:
        raise NotImplementedError

    def index_gate(self, gate: Gate) -> Gate:
        raise NotImplementedError

    def within(
        self, a: pa.Table, b: pa.Table, near: np.ndarray, same: bool, gate: Gate, symmetry: pa.Table | None
    ) -> np.ndarray:
        """Which of the pairs ``near`` by index are in range."""
        raise NotImplementedError


def near_rows(
    a: pa.Table,
    b: pa.Table,
    same: bool,
    gate: Gate,
    coords: str,
    score: str | None = None,
    metric: Metric | None = None,
    symmetry: pa.Table | None = None,
) -> np.ndarray:
    """Boolean matrix of the pairs of rows that pass the gate."""
    s, t = _scores(a, score), _scores(b, score)
    if metric is None:
        return alike(matrix(a[coords]), matrix(b[coords]), gate, s, t)
    near = alike(matrix(a["_index"]), matrix(b["_index"]), metric.index_gate(gate), s, t)
    return metric.within(a, b, near, same, gate, symmetry)


def grouped(
    rows: DataFrame,
    by: Sequence[str],
    run: Callable[[pa.Table, pa.Table | None], pa.Table],
    schema: T.StructType,
    extra: DataFrame | None = None,
) -> DataFrame:
    """``run`` per group, with the group's rows of ``extra``, whose columns start like ``by``."""
    if extra is None:
        return rows.groupBy(*by).applyInArrow(lambda t: run(t, None), schema)
    # Both sides may come from one table; new names keep their columns apart.
    named = [f"_by{n}" for n in range(len(by))]
    extra = extra.toDF(*named, *extra.columns[len(by) :])
    others = extra.groupBy(*named)
    return rows.groupBy(*by).cogroup(others).applyInArrow(lambda t, x: run(t, x), schema)


def per_tile(extra: DataFrame, touching: DataFrame, keys: Sequence[str], itself: bool) -> DataFrame:
    """One copy of a key's rows of ``extra`` for each of its tiles.

    A key with many tiles is spread, so no task serves all of them.
    """
    values = [c for c in extra.columns if c not in keys]
    return hot_join(tile_names(touching, keys, itself), extra, keys).select(*keys, *TILE, *values)


def regions(df: DataFrame, keys: Sequence[str], lanes: int, shifted: bool) -> DataFrame:
    """Copy rows to ``_region``: wider cells, each with a rim of the touching cells.

    ``_core`` is true in the region a row lies in. Regions are as wide as it
    takes to hold about half of ``REGION_ROWS``; those with more than that,
    counted first, are left out. ``shifted`` moves all borders by half a region.
    """
    keys = list(keys)

    def wide(cell: Column, factor: Column) -> Column:
        half = F.call_function("div", factor, F.lit(2)) if shifted else F.lit(0)
        return F.transform(cell, lambda x: F.floor((x + half) / factor).cast("bigint"))

    # Cells decide, so that rows are only joined to what their cell belongs to.
    cells = cut(df.groupBy(*keys, "_cell").agg(F.count("*").alias("_rows")))
    occupied = [F.approx_count_distinct(wide(F.col("_cell"), F.lit(f))).alias(f"_at{f}") for f in WIDENINGS]
    filled = [F.when(F.col("_n") >= F.col(f"_at{f}") * (REGION_ROWS / 2), F.lit(f)) for f in WIDENINGS]
    factors = (
        cells.groupBy(*keys)
        .agg(F.sum("_rows").alias("_n"), *occupied)
        .select(*keys, F.coalesce(*filled, F.lit(WIDENINGS[-1])).alias("_factor"))
    )
    moves = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in s]) for s in product((-1, 0, 1), repeat=lanes)])
    around = F.array_distinct(
        F.transform(moves, lambda s: wide(F.zip_with("_cell", s, lambda x, y: x + y), F.col("_factor")))
    )
    own = wide(F.col("_cell"), F.col("_factor"))
    placed = hot_join(cells, factors, keys).withColumn("_own", own).withColumn("_region", F.explode(around))
    placed = cut(placed.withColumn("_core", F.col("_own") == F.col("_region")).drop("_own", "_factor"))
    sizes = placed.groupBy(*keys, "_region").agg(F.sum("_rows").alias("_n"), F.max("_core").alias("_held"))
    fitting = sizes.where((F.col("_n") <= REGION_ROWS) & F.col("_held")).select(*keys, "_region")
    chosen = hot_join(placed.drop("_rows"), fitting, [*keys, "_region"], "left_semi", grows=True)
    return hot_join(df, chosen, [*keys, "_cell"], grows=True)


@dataclass(frozen=True)
class Neighbourhood:
    """How the rows of ``(keys, pos, ...)`` tables reach their neighbours.

    By distance, the tables carry coordinates and the ``_cell`` they lie in.

    ``reach(df, how)`` aggregates ``value`` over each row's neighbours, itself
    included. ``touch(df, others)`` lists the rows near any of the others.
    ``gather(df, shifted, run, schema)``, where there is one, runs ``run(rows,
    near)`` on regions of bounded size that cover the rows; ``_core`` tells the
    rows of a region whose neighbours are all there.
    ``held(df)``, where there is one, measures all pairs of ``df`` once: the
    ``reach`` it returns serves the same rows, or what is left of them, and so does
    ``listed(df)``, the neighbours of the rows that are ``_asked`` for.
    """

    reach: Callable[[DataFrame, str], DataFrame]
    touch: Callable[[DataFrame, DataFrame], DataFrame]
    gather: Callable[[DataFrame, bool, Callable, T.StructType], DataFrame] | None = None
    held: Callable[[DataFrame], Neighbourhood] | None = None
    listed: Callable[[DataFrame], DataFrame] | None = None


def by_distance(
    keys: Sequence[str],
    gate: Gate,
    coords: str,
    score: str | None = None,
    block_rows: int = GROUP_LIMIT,
    metric: Metric | None = None,
) -> Neighbourhood:
    """Neighbours found by distance, tile by tile.

    Tiles send on at most one partial result per row, never pairs. Under a
    ``metric``, rows carry its ``_index`` and tiles measure what that lets pass.
    """
    keys = list(keys)
    spot = [*keys, "pos"]
    index = [] if metric is None else ["_index"]
    carried = [*spot, "_cell", coords, *index, *([score] if score else [])]

    def compared(
        df: DataFrame, run: Callable, schema: T.StructType, others: DataFrame | None = None, bounded: bool = False
    ) -> DataFrame:
        spread = tiles(df, keys, "pos", gate.lanes, block_rows, others)
        extra = None
        if bounded or (metric is not None and metric.symmetry is not None):
            touching = touching_cells(df, keys, gate.lanes, block_rows, others)
        if bounded:
            spread = dealt(spread, touching, keys)
        if metric is not None and metric.symmetry is not None:
            extra = per_tile(metric.symmetry, touching, keys, others is None)
        return grouped(spread, [*keys, *TILE], run, schema, extra)

    def reach(df: DataFrame, how: str) -> DataFrame:
        fold, blank = FOLDS[how]

        def compare(table: pa.Table, symmetry: pa.Table | None) -> pa.Table:
            a, b, same = _sides(table)
            parts = [table.select(spot).slice(0, 0).append_column("value", pa.array([], pa.int64()))]
            if a.num_rows and b.num_rows:
                mask = near_rows(a, b, same, gate, coords, score, metric, symmetry)
                sides = [(a, mask, b)] if same else [(a, mask, b), (b, mask.T, a)]
                for rows, within, others in sides:
                    values = np.where(within, numbers(others["value"])[None, :], blank)
                    folded = pa.array(fold(values, axis=1), pa.int64())
                    parts.append(rows.select(spot).append_column("value", folded))
            return pa.concat_tables(parts)

        schema = T.StructType([*[df.schema[c] for c in spot], T.StructField("value", T.LongType())])
        partial = compared(df.select(*carried, "value"), compare, schema)
        return partial.groupBy(*spot).agg(AGGREGATES[how]("value").alias("value"))

    def touch(df: DataFrame, others: DataFrame) -> DataFrame:
        def compare(table: pa.Table, symmetry: pa.Table | None) -> pa.Table:
            a, b, _ = _sides(table)
            if not a.num_rows or not b.num_rows:
                return table.select(spot).slice(0, 0)
            mask = near_rows(a, b, False, gate, coords, score, metric, symmetry)
            return a.select(spot).filter(pa.array(mask.any(axis=1)))

        schema = T.StructType([df.schema[c] for c in spot])
        return compared(df.select(*carried), compare, schema, others.select(*carried)).distinct()

    def gather(df: DataFrame, shifted: bool, run: Callable, schema: T.StructType) -> DataFrame:
        def local(table: pa.Table, _: None) -> pa.Table:
            return run(table, near_rows(table, table, True, gate, coords, score, metric))

        columns = [c for c in df.columns if c not in carried]
        spread = regions(df.select(*carried, *columns), keys, gate.lanes, shifted)
        return grouped(spread, [*keys, "_region"], local, schema)

    def held(df: DataFrame) -> Neighbourhood:
        def measure(table: pa.Table, symmetry: pa.Table | None) -> pa.Table:
            a, b, same = _sides(table)
            near = np.zeros((a.num_rows, b.num_rows), dtype=bool)
            if a.num_rows and b.num_rows:
                near = near_rows(a, b, same, gate, coords, score, metric, symmetry)
            # Only rows and columns with a neighbour are written, a bit for each pair.
            own, other = near.any(axis=1), near.any(axis=0)
            columns = {c: table[c].slice(0, int(near.any())) for c in (*keys, *TILE)}
            if near.any():
                for name, rows, some in (("_pos_a", a, own), ("_pos_b", b, other)):
                    columns[name] = pa.array([numbers(rows["pos"])[some]], pa.list_(pa.int64()))
                columns["_near"] = pa.array([np.packbits(near[own][:, other]).tobytes()], pa.binary())
            else:
                columns |= {c: pa.array([], pa.list_(pa.int64())) for c in ("_pos_a", "_pos_b")}
                columns["_near"] = pa.array([], pa.binary())
            return pa.table(columns)

        listed = T.ArrayType(T.LongType())
        cell = df.schema["_cell"].dataType
        named = [*[df.schema[k] for k in keys], T.StructField("_cell_a", cell), T.StructField("_block_a", T.IntegerType())]
        named += [T.StructField("_cell_b", cell), T.StructField("_block_b", T.IntegerType())]
        named += [T.StructField(c, listed) for c in ("_pos_a", "_pos_b")]
        schema = T.StructType([*named, T.StructField("_near", T.BinaryType())])
        blocks = cut(_cells(df, keys, block_rows))
        hot = find_hot(df, [*keys, "_cell"])
        measured = cut(compared(df.select(*carried), measure, schema, bounded=True))
        known = (keys, measured, blocks, hot)
        return Neighbourhood(
            lambda rows, how: _recall(rows, how, *known), touch, listed=lambda rows: _listed(rows, *known)
        )

    # What a metric needs of a key is sent to tiles only.
    local = metric is None or metric.symmetry is None
    return Neighbourhood(reach, touch, gather if local else None, None if local else held)


@dataclass(frozen=True)
class _Side:
    """One side of a measured tile: which of its rows are still there, and their values."""

    pos: np.ndarray
    there: np.ndarray
    values: dict[str, np.ndarray]


def _measured(
    df: DataFrame,
    columns: list[str],
    run: Callable[[np.ndarray, list[_Side]], Iterator[dict[str, pa.Array]]],
    fields: list[T.StructField],
    keys: list[str],
    measured: DataFrame,
    blocks: DataFrame,
    hot: DataFrame | bool,
) -> DataFrame:
    """``run`` on each measured tile: its near pairs and its sides, one if they are the same.

    It gives columns of as many rows as it likes, which get the tile's keys. The
    ``columns`` of ``df`` are the values of rows; rows gone since are not ``there``.
    """
    block = F.pmod(F.xxhash64("pos"), F.col("_blocks")).cast("int").alias("_block")
    placed = hot_join(df.select(*keys, "pos", "_cell", *columns), blocks, [*keys, "_cell"], hot=hot, grows=True)
    packed = placed.select(*keys, "_cell", block, F.struct("pos", *columns).alias("_row"))
    # A block holds a bounded number of rows, so its values travel as one row.
    packed = packed.groupBy(*keys, "_cell", "_block").agg(F.collect_list("_row").alias("_rows"))
    tiled = measured
    for side in ("_a", "_b"):
        values = packed.select(
            *keys, *[F.col(c).alias(c + side) for c in ("_cell", "_block", "_rows")]
        )
        tiled = tiled.join(shuffled(values), [*keys, "_cell" + side, "_block" + side])

    def parts(column: pa.Array, field: str | None = None) -> list[np.ndarray]:
        flat = column.values if field is None else column.values.field(field)
        return np.split(flat.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[1:-1])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = {side: parts(batch["_pos" + side]) for side in ("_a", "_b")}
            rows = {side: {c: parts(batch["_rows" + side], c) for c in ("pos", *columns)} for side in pos}
            cells = [batch[c].to_pylist() for c in TILE]
            same = [t[:2] == t[2:] for t in zip(*cells, strict=True)]
            for n in range(batch.num_rows):
                sides = []
                for side in ("_a",) if same[n] else ("_a", "_b"):
                    own, given = pos[side][n], rows[side]["pos"][n]
                    order = np.argsort(given)
                    at = order[np.minimum(np.searchsorted(given, own, sorter=order), len(given) - 1)]
                    sides.append(_Side(own, given[at] == own, {c: rows[side][c][n][at] for c in columns}))
                a, b = pos["_a"][n], pos["_b"][n]
                bits = np.frombuffer(batch["_near"][n].as_py(), dtype=np.uint8)
                near = np.unpackbits(bits, count=len(a) * len(b)).reshape(len(a), len(b)).astype(bool)
                for found in run(near, sides):
                    arrays = [pa.array(v, types[c]) if not isinstance(v, pa.Array) else v for c, v in found.items()]
                    named = [batch[k].take(pa.array(np.full(len(arrays[0]), n))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*named, *arrays], names=[*keys, *found])

    listed = pa.list_(pa.int64())
    types = {f.name: listed if isinstance(f.dataType, T.ArrayType) else pa.int64() for f in fields}
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])
    return tiled.select(*measured.columns, "_rows_a", "_rows_b").mapInArrow(over, schema)


def _facing(near: np.ndarray, sides: list[_Side]) -> Iterator[tuple[_Side, np.ndarray, _Side]]:
    """Each side of a tile with its neighbours on the other."""
    yield sides[0], near, sides[-1]
    if len(sides) > 1:
        yield sides[1], near.T, sides[0]


def _recall(df: DataFrame, how: str, keys: list[str], *known: DataFrame | bool) -> DataFrame:
    """``reach`` over tiles that are measured already; rows gone since count for nothing."""
    fold, blank = FOLDS[how]

    def run(near: np.ndarray, sides: list[_Side]) -> Iterator[dict[str, np.ndarray]]:
        for own, within, other in _facing(near, sides):
            if own.there.any():
                values = np.where(other.there, other.values["value"], blank)
                folded = fold(np.where(within[own.there], values[None, :], blank), axis=1)
                yield {"pos": own.pos[own.there], "value": folded}

    fields = [df.schema["pos"], T.StructField("value", T.LongType())]
    partial = _measured(df, ["value"], run, fields, keys, *known)
    return partial.groupBy(*keys, "pos").agg(AGGREGATES[how]("value").alias("value"))


def _listed(df: DataFrame, keys: list[str], *known: DataFrame | bool) -> DataFrame:
    """(keys, pos, _near, _weights): neighbours of the ``_asked`` rows and their ``weight``, in parts."""

    def run(near: np.ndarray, sides: list[_Side]) -> Iterator[dict[str, pa.Array]]:
        for own, within, other in _facing(near, sides):
            asked = own.there & (own.values["_asked"] > 0)
            if asked.any():
                mask = within[asked] & other.there
                ends = pa.array(np.concatenate([[0], np.cumsum(mask.sum(axis=1))]), pa.int32())
                at = np.nonzero(mask)[1]
                lists = [pa.array(v[at], pa.int64()) for v in (other.pos, other.values["weight"])]
                yield {
                    "pos": pa.array(own.pos[asked], pa.int64()),
                    **{c: pa.ListArray.from_arrays(ends, v) for c, v in zip(("_near", "_weights"), lists, strict=True)},
                }

    fields = [df.schema["pos"], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("_near", "_weights")]]
    return _measured(df, ["weight", "_asked"], run, fields, keys, *known)


def by_pairs(pairs: DataFrame, keys: Sequence[str]) -> Neighbourhood:
    """Neighbours listed as ``(keys, a, b)`` positions."""
    keys = list(keys)
    both = pairs.select(*keys, "a", "b").unionByName(
        pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    )

    def around(df: DataFrame, *extra: str) -> DataFrame:
        ends = df.select(*keys, F.col("pos").alias("b"), *extra)
        return both.join(ends, [*keys, "b"]).select(*keys, F.col("a").alias("pos"), *extra)

    def reach(df: DataFrame, how: str) -> DataFrame:
        rows = df.select(*keys, "pos", "value").unionByName(around(df, "value"))
        return rows.groupBy(*keys, "pos").agg(AGGREGATES[how]("value").alias("value"))

    def touch(df: DataFrame, others: DataFrame) -> DataFrame:
        return around(others).distinct().join(df.select(*keys, "pos"), [*keys, "pos"], "left_semi")

    return Neighbourhood(reach, touch)


def near_pairs(
    df: DataFrame,
    keys: Sequence[str],
    ident: str,
    index: str,
    gate: Gate,
    measure: Callable[[pa.Table, pa.Table, pa.Table | None], Callable[[slice, slice, np.ndarray], np.ndarray]],
    max_dist: float,
    per_key: DataFrame | None = None,
    bound: int | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Pairs ``(keys, a, b, dist)``, ``a < b``, with a measured distance in range.

    ``gate`` on the ``index`` vectors picks the pairs to measure and must let
    every pair in range pass. ``measure`` gets the rows of both sides and the rows
    of ``per_key`` of that key. It returns a function from a block (its rows, its
    columns, which of its pairs to measure) to the matrix of their distances;
    others are infinite.
    """
    keys = list(keys)
    # A vector with a gap or without a finite value is near nothing.
    df = df.where(finite(index))
    schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("a", T.LongType()),
            T.StructField("b", T.LongType()),
            T.StructField("dist", T.DoubleType()),
        ]
    )

    def emit(a: pa.Table, b: pa.Table, same: bool, extra: pa.Table | None = None) -> pa.Table:
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        if a.num_rows and b.num_rows:
            x, y = matrix(a[index]), matrix(b[index])
            distances = measure(a, b, extra)
            step = max(1, BLOCK_PAIRS // b.num_rows)
            for start in range(0, a.num_rows, step):
                # Compared with itself, a row meets those behind it only.
                first = start if same else 0
                rows, columns = slice(start, start + step), slice(first, b.num_rows)
                near = alike(x[rows], y[columns], gate)
                near = np.triu(near, 1) if same else near
                if near.any():
                    dist = distances(rows, columns, near)
                    i, j = np.nonzero(dist <= max_dist)
                    found.append((i + start, j + first, dist[i, j]))
        i, j, dist = (np.concatenate(v) for v in zip(*found, strict=True))
        left, right = numbers(a[ident])[i], numbers(b[ident])[j]
        columns = {k: a[k].take(pa.array(i)) for k in keys}
        columns["a"] = pa.array(np.minimum(left, right), pa.int64())
        columns["b"] = pa.array(np.maximum(left, right), pa.int64())
        columns["dist"] = pa.array(dist, pa.float64())
        return pa.table(columns)

    extra = None if per_key is None else per_key.select(*keys, *[c for c in per_key.columns if c not in keys])
    small, large = split_by_size(df, keys, group_limit, bound)
    result = grouped(small, keys, lambda t, x: emit(t, t, True, x), schema, extra)
    if large is not None:
        placed = cut(with_cells(large, keys, gate, index, block_rows=group_limit))
        spread = tiles(placed, keys, ident, gate.lanes, group_limit)
        touching = touching_cells(placed, keys, gate.lanes, group_limit)
        spread = dealt(spread, touching, keys)
        if extra is not None:
            extra = per_tile(extra, touching, keys, True)
        tiled = grouped(spread, [*keys, *TILE], lambda t, x: emit(*_sides(t), x), schema, extra)
        result = result.unionByName(tiled)
    return result


def pair_rmsd(
    df: DataFrame,
    keys: Sequence[str],
    ident: str = "cand_id",
    coords: str = "coords",
    max_dist: float = 0.3,
    dims: int = 1,
    bound: int | None = None,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Pairs ``(keys, a, b, dist)`` with ``a < b`` at most ``max_dist`` apart.

    Exact copies would make every pair of their group a result row, so pass
    ``structures`` of the candidates when copies may be frequent.
    """

    def measure(a: pa.Table, b: pa.Table, _: None) -> Callable[[slice, slice, np.ndarray], np.ndarray]:
        x, y = matrix(a[coords]), matrix(b[coords])

        def block(rows: slice, columns: slice, near: np.ndarray) -> np.ndarray:
            dist = np.full(near.shape, np.inf)
            i, j = np.nonzero(near)
            dist[i, j] = rmsd(x[rows], y[columns], i, j, dims)
            return dist

        return block

    gate = Gate(max_dist, dims=dims)
    rows = df.select(*keys, ident, coords)
    return near_pairs(
        rows, keys, ident, coords, gate, measure, max_dist, None, bound, group_limit
    )
