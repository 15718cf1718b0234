"""Order-dependent selection: first-come de-duplication and threshold clusters.

Both are sequential by definition. Inside a small key the sequence is simply
followed. A large key is worked off in rounds over many rows at once, each
deciding exactly those rows whose outcome no undecided row can still change,
so the result is the sequential one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidate_funnel.functions.scalars import finite
from candidate_funnel.operators.neighbours import (
    GROUP_LIMIT,
    Gate,
    Metric,
    Neighbourhood,
    by_distance,
    by_pairs,
    grouped,
    near_rows,
    numbers,
    split_by_size,
    with_cells,
)
from candidate_funnel.operators.select import rank
from candidate_funnel.operators.skew import hot_join, keyed, largest_group, shuffled
from candidate_funnel.session import cut, discard

# Share of the open rows that regions must tell for a round over tiles to wait.
SETTLED_SHARE = 0.02

# Neighbours of one key that a task lists at a time, and position ranges (as a power of
# two) by which rows of equal neighbour counts are asked for.
LISTED = 1 << 22
RANGE_BITS = 10

# Growth of the prefixes a large key is de-duplicated in.
PREFIX_GROWTH = 4

Decide = Callable[[pa.Table, pa.Table | None], pa.Table]


def first_kept(near: np.ndarray) -> np.ndarray:
    """Keep each row, in order, unless it is near one already kept."""
    kept = np.zeros(len(near), dtype=bool)
    for i in range(len(near)):
        kept[i] = not near[i, kept].any()
    return kept


def crowded_first(near: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Centre of each row: the busiest open row takes its open neighbours.

    Neighbour counts follow the rows still open; the earlier row wins a tie.
    """
    centre = np.full(len(near), -1)
    open_rows = np.ones(len(near), dtype=bool)
    count = near @ weight
    while open_rows.any():
        busiest = int(np.argmax(np.where(open_rows, count, -1)))
        members = near[busiest] & open_rows
        members[busiest] = True
        centre[members] = busiest
        open_rows &= ~members
        count = count - near[:, members] @ weight[members]
    return centre


def _listed(points: pa.Table, pairs: pa.Table, ident: str) -> np.ndarray:
    """Neighbour matrix of ordered points from listed pairs of ids."""
    ids = numbers(points[ident])
    order = np.argsort(ids)
    near = np.eye(len(ids), dtype=bool)
    if pairs.num_rows:
        a = order[np.searchsorted(ids, numbers(pairs["a"]), sorter=order)]
        b = order[np.searchsorted(ids, numbers(pairs["b"]), sorter=order)]
        near[a, b] = near[b, a] = True
    return near


def _present(pairs: DataFrame, points: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Pairs whose two ends are both among the points, as given ids and positions."""
    ends = points.select(*keys, ident, "pos")
    return (
        pairs.select(*keys, "a", "b", "dist")
        .join(ends.withColumnsRenamed({ident: "a", "pos": "pos_a"}), [*keys, "a"])
        .join(ends.withColumnsRenamed({ident: "b", "pos": "pos_b"}), [*keys, "b"])
    )


def _in_range(pairs: DataFrame, gate: Gate) -> DataFrame:
    return pairs.where(F.col("dist") < gate.rmsd if gate.strict else F.col("dist") <= gate.rmsd)


def _follow(
    ordered: DataFrame,
    keys: list[str],
    ident: str,
    schema: T.StructType,
    decide: Decide,
    pairs: DataFrame | None,
    metric: Metric | None = None,
) -> DataFrame:
    """Run ``decide`` over each small key in order.

    It also gets the key's listed pairs, or what the metric needs of the key.
    """
    extra = None if metric is None else metric.symmetry
    if pairs is not None:
        for end in ("a", "b"):
            present = ordered.select(*keys, F.col(ident).alias(end))
            pairs = pairs.join(present, [*keys, end], "left_semi")
        extra = pairs.select(*keys, "a", "b")
    return grouped(ordered, keys, lambda points, x: decide(points.sort_by("pos"), x), schema, extra)


def _any(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class Likeness:
    """How the rows of one small key are compared: by pairs, a metric or coordinates."""

    gate: Gate
    ident: str
    coords: str
    score: str | None = None
    listed: bool = False
    metric: Metric | None = None

    def near(self, points: pa.Table, extra: pa.Table | None) -> np.ndarray:
        if not self.listed:
            return near_rows(points, points, True, self.gate, self.coords, self.score, self.metric, extra)
        near = _listed(points, extra, self.ident)
        if self.score:
            s = numbers(points[self.score])
            near &= np.abs(s[:, None] - s[None, :]) < self.gate.score
        return near


def _keeper(likeness: Likeness) -> Decide:
    """De-duplication of one small key."""

    def decide(points: pa.Table, extra: pa.Table | None) -> pa.Table:
        if not points.num_rows:
            return points
        return points.filter(pa.array(first_kept(likeness.near(points, extra))))

    return decide


def _clusterer(likeness: Likeness, weight: str | None, name: str) -> Decide:
    """Clustering of one small key; ``name`` is filled with the centre's id."""

    def decide(points: pa.Table, extra: pa.Table | None) -> pa.Table:
        if not points.num_rows:
            return points.append_column(name, pa.array([], pa.int64()))
        near = likeness.near(points, extra)
        heavy = numbers(points[weight]) if weight else np.ones(points.num_rows, dtype=np.int64)
        centre = pa.array(crowded_first(near, heavy))
        return points.append_column(name, points[likeness.ident].take(centre))

    return decide


def keep_in_rounds(
    state: DataFrame,
    keys: list[str],
    near: Neighbourhood,
    decide: Decide,
    pairs: DataFrame | None,
    limit: int,
    metric: Metric | None = None,
) -> list[DataFrame]:
    """Rows kept among ``state`` alone.

    Each round keeps the rows that come before all their open neighbours and
    drops what is near them. Once no key has more than ``limit`` open rows,
    the rest is settled at once.
    """
    spot = [*keys, "pos"]
    kept = []
    given = state
    while largest_group(state, keys) > limit:
        earliest = near.reach(state.withColumn("value", F.col("pos")), "min")
        first = (F.col("value") == F.col("pos")).cast("bigint").alias("value")
        marked = cut(state.join(shuffled(earliest.select(*spot, first)), spot))
        kept.append(marked.where("value = 1").drop("value"))
        if kept[-1].isEmpty():
            raise RuntimeError("no row comes before all its neighbours; ids or positions repeat")
        untouched = near.reach(marked, "max").where("value = 0").select(*spot)
        before, state = state, cut(marked.drop("value").join(shuffled(untouched), spot, "left_semi"))
        if before is not given:
            discard(before)
    return [*kept, cut(_follow(state, keys, "pos", state.schema, decide, pairs, metric))]


def keep_in_prefixes(
    state: DataFrame,
    keys: list[str],
    near: Neighbourhood,
    decide: Decide,
    pairs: DataFrame | None,
    limit: int,
    metric: Metric | None = None,
) -> DataFrame:
    """Positions to keep, settled in prefixes of growing length.

    Each prefix first loses what is near a row kept so far, so a crowded key
    compares its rows with the few it keeps and not with each other.
    """
    last = state.agg(F.max("pos")).first()[0]
    kept: list[DataFrame] = []
    low, high = 0, limit
    while low < last:
        part = state.where((F.col("pos") > low) & (F.col("pos") <= high))
        if kept:
            part = cut(part.join(shuffled(near.touch(part, _any(kept))), [*keys, "pos"], "left_anti"))
        kept += keep_in_rounds(part, keys, near, decide, pairs, limit, metric)
        low, high = high, high * PREFIX_GROWTH
    return _any(kept).select(*keys, "pos")


def settled(near: np.ndarray, weight: np.ndarray, pos: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Centres (row numbers, or -1) that a region can tell without the rest of its key.

    Rows come up by priority, as in ``crowded_first``. One is a centre if no row
    within two steps is open that outranks it or whose neighbours are partly
    elsewhere (not ``core``). Otherwise it waits until a row around it changes.
    Selections further than two steps apart do not affect each other, so any
    order of them, in any regions, ends in the same clusters.
    """
    n = len(near)
    ahead = np.argsort(np.argsort(pos))
    count = near @ weight
    open_rows = np.ones(n, dtype=bool)
    waiting = np.zeros(n, dtype=bool)
    centre = np.full(n, -1)
    heap = [(-int(count[r]), int(ahead[r]), int(r)) for r in np.nonzero(core)[0]]
    heapq.heapify(heap)
    while heap:
        minus, _, r = heapq.heappop(heap)
        if not open_rows[r] or waiting[r] or -minus != count[r]:
            continue
        two_steps = near[near[r] & open_rows].any(axis=0)
        if (two_steps & open_rows & (waiting | ~core)).any():
            waiting[r] = True
            continue
        members = near[r] & open_rows
        centre[members] = r
        open_rows &= ~members
        lost = weight[members] @ near[members]
        count = count - lost
        changed = (lost > 0) & open_rows
        around = near[near[changed | members].any(axis=0)].any(axis=0)
        again = (changed & core) | (waiting & open_rows & around)
        waiting &= ~again
        for q in np.nonzero(again)[0].tolist():
            heapq.heappush(heap, (-int(count[q]), int(ahead[q]), q))
    return centre


def settle(state: DataFrame, keys: list[str], near: Neighbourhood, shifted: bool) -> DataFrame:
    """``(keys, pos, centre)`` of all rows that regions tell by themselves."""

    def run(rows: pa.Table, mask: np.ndarray) -> pa.Table:
        pos = numbers(rows["pos"])
        core = rows["_core"].to_numpy()
        centre = settled(mask, numbers(rows["weight"]), pos, core)
        told = centre >= 0
        found = rows.select([*keys, "pos"]).filter(pa.array(told))
        return found.append_column("centre", pa.array(pos[centre[told]], pa.int64()))

    schema = T.StructType([*[state.schema[c] for c in (*keys, "pos")], T.StructField("centre", T.LongType())])
    # Regions overlap; what two of them tell of a row is the same.
    return near.gather(state, shifted, run, schema).distinct()


def followed(
    asked: np.ndarray, sizes: np.ndarray, near: np.ndarray, weights: np.ndarray, shift: int, last: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows and of their centres, as far as listed neighbours tell the sequence.

    Each ``asked`` row comes with ``sizes`` open neighbours, one after the other in
    ``near``. Rows that are not asked for have less than the ``least`` priority and
    counts only fall, so the asked rows above that are taken as in ``crowded_first``.
    """
    rows, where = np.unique(near, return_index=True)
    heavy = weights[where]
    other = np.searchsorted(rows, near).astype(np.int32)
    own = np.repeat(np.searchsorted(rows, asked).astype(np.int32), sizes)

    def lists(by: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(by, kind="stable")
        return of[order], np.concatenate([[0], np.cumsum(np.bincount(by, minlength=len(rows)))])

    around, starts = lists(own, other)
    seen_by, seen_from = lists(other, own)
    count = np.zeros(len(rows), dtype=np.int64)
    np.add.at(count, own, heavy[other])
    first = np.unique(own)
    priority = count[first] << shift | last - rows[first]
    order = np.argsort(-priority)
    first, priority = first[order], priority[order]

    centre = np.full(len(rows), -1)
    open_rows = np.ones(len(rows), dtype=bool)
    again: list[tuple[int, int]] = []
    at = 0
    while again or at < len(first):
        if again and (at == len(first) or -again[0][0] > priority[at]):
            minus, r = heapq.heappop(again)
            given = -minus
        else:
            given, r = int(priority[at]), int(first[at])
            at += 1
        if not open_rows[r]:
            continue
        now = int(count[r]) << shift | last - int(rows[r])
        if now < given:
            # It has lost neighbours since; others may come first now.
            if now >= least:
                heapq.heappush(again, (-now, r))
            continue
        members = around[starts[r] : starts[r + 1]]
        members = members[open_rows[members]]
        centre[members] = r
        open_rows[members] = False
        if len(members) > 1:
            number = seen_from[members + 1] - seen_from[members]
            before = np.cumsum(number) - number
            seen = np.arange(number.sum()) + np.repeat(seen_from[members] - before, number)
            np.subtract.at(count, seen_by[seen], np.repeat(heavy[members], number))
    told = centre >= 0
    return rows[told], rows[centre[told]]


def follow_listed(state: DataFrame, keys: list[str], near: Neighbourhood, shift: int, last: int) -> DataFrame:
    """``(keys, pos, centre)`` of the rows that the busiest rows' neighbours tell.

    Of each key, as many rows of the highest priority are asked for as have ``LISTED``
    neighbours together, so one task follows the sequence of a key, or of the next
    part of a larger one, in bounded memory.
    """
    spot = [*keys, "pos"]
    fine = max(0, int(last).bit_length() - RANGE_BITS)
    priority = F.shiftleft(F.col("value"), shift).bitwiseOR(F.lit(last) - F.col("pos")).alias("_priority")
    count = near.reach(state.withColumn("value", F.col("weight")), "sum")
    ranked = cut(count.select(*spot, "value", priority))

    level = F.shiftright("_priority", fine).alias("_level")
    levels = ranked.groupBy(*keys, level).agg(F.count("*").alias("_rows"), F.max("value").alias("_count"))
    levels = levels.join(ranked.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    # A row has no more neighbours than they weigh or than there are rows.
    listed = F.col("_rows") * F.least("_count", "_n")
    so_far = Window.partitionBy(*keys).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0)
    fitting = levels.withColumn("_listed", F.sum(listed).over(so_far)).where(F.col("_listed") <= LISTED)
    whole = F.sum("_rows") == F.max("_n")
    least = F.when(whole, F.lit(0).cast("bigint")).otherwise(F.shiftleft(F.min("_level"), fine))
    least = cut(fitting.groupBy(*keys).agg(least.alias("_least")))

    wanted = (F.col("_priority") >= F.col("_least")).cast("bigint").alias("_asked")
    asked = hot_join(ranked, least, keys).select(*spot, wanted)
    lists = near.listed(state.join(shuffled(asked), spot))

    def follow(rows: pa.Table, bound: pa.Table) -> pa.Table:
        pos, centre = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if rows.num_rows:
            flat = [numbers(pa.compute.list_flatten(rows[c])) for c in ("_near", "_weights")]
            sizes = numbers(pa.compute.list_value_length(rows["_near"]))
            pos, centre = followed(numbers(rows["pos"]), sizes, *flat, shift, last, bound["_least"][0].as_py())
        found = {k: rows[k].take(pa.array(np.zeros(len(pos), dtype=np.int64))) for k in keys}
        return pa.table({**found, "pos": pa.array(pos, pa.int64()), "centre": pa.array(centre, pa.int64())})

    schema = T.StructType([*[state.schema[c] for c in spot], T.StructField("centre", T.LongType())])
    return grouped(lists, keys, follow, schema, least)


def cluster_in_rounds(
    state: DataFrame,
    keys: list[str],
    near: Neighbourhood,
    decide: Decide,
    pairs: DataFrame | None,
    limit: int,
    metric: Metric | None = None,
) -> DataFrame:
    """Centre position of every row: ``(keys, pos, centre)``.

    A row becomes a centre when it outranks every open row up to two steps
    away. Clusters change neighbour counts only that far, and counts only
    fall, so its turn would come with exactly these members. Regions first
    follow the sequence as far as it stays inside them (``settled``), so a long
    chain of rows does not cost a round for each. Where pairs are held, the sequence
    is followed over listed neighbours instead (``followed``). Once no key has
    more than ``limit`` open rows, the rest is settled at once.
    """
    spot = [*keys, "pos"]
    none = np.iinfo(np.int64).max
    # Neighbour count and position compete as one bigint.
    largest = state.groupBy(*keys).agg(F.sum("weight").alias("_w"), F.max("pos").alias("_p"))
    heaviest, last = largest.agg(F.max("_w"), F.max("_p")).first()
    shift = int(last).bit_length()
    if int(heaviest).bit_length() + shift > 62:
        raise ValueError("a key has too many distinct candidates to cluster")
    done = []
    given = state
    shifted, n_open = False, state.count() if near.gather else 0
    if near.held is not None and largest_group(state, keys) > limit:
        # Measuring is the dear part of a round, and no pair changes between rounds.
        near = near.held(state)
    while largest_group(state, keys) > limit:
        if near.gather is not None or near.listed is not None:
            if near.listed is not None:
                told = cut(follow_listed(state, keys, near, shift, int(last)))
            else:
                told = cut(settle(state, keys, near, shifted))
            shifted = not shifted
            n_told = told.count()
            if n_told:
                done.append(told)
                before, state = state, cut(state.join(shuffled(told), spot, "left_anti"))
                if before is not given:
                    discard(before)
            n_open -= n_told
            # A round over all pairs of tiles is for what these cannot tell.
            if n_told > (0 if near.listed is not None else SETTLED_SHARE * (n_open + n_told)):
                continue
        count = near.reach(state.withColumn("value", F.col("weight")), "sum")
        priority = F.shiftleft(F.col("value"), shift).bitwiseOR(F.lit(last) - F.col("pos"))
        ranked = cut(count.select(*spot, priority.alias("priority")))
        one_step = near.reach(state.join(shuffled(ranked.withColumnRenamed("priority", "value")), spot), "max")
        two_steps = near.reach(state.join(shuffled(one_step), spot), "max").join(shuffled(ranked), spot)
        chosen = F.when(F.col("value") == F.col("priority"), F.col("pos")).otherwise(F.lit(none))
        centres = cut(two_steps.select(*spot, chosen.alias("value")))
        taken = cut(near.reach(state.join(shuffled(centres), spot), "min"))
        done.append(
            taken.where(F.col("value") < none).select(*spot, F.col("value").alias("centre"))
        )
        if done[-1].isEmpty():
            raise RuntimeError("no row outranks its neighbours; ids or positions repeat")
        rest = taken.where(F.col("value") == none).select(*spot)
        before, state = state, cut(state.join(shuffled(rest), spot, "left_semi"))
        if near.gather is not None:
            n_open = state.count()
        discard(ranked, centres)
        if before is not given:
            discard(before)
    schema = T.StructType([*state.schema.fields, T.StructField("centre", T.LongType())])
    done.append(_follow(state, keys, "pos", schema, decide, pairs, metric).select(*spot, "centre"))
    return cut(_any(done))


def _sound(
    df: DataFrame, coords: str, pairs: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows with finite coordinates, and the others where coordinates are compared."""
    if pairs is not None:
        return df, None
    return df.where(finite(coords)), df.where(~finite(coords))


def _indexed(df: DataFrame, metric: Metric | None) -> DataFrame:
    return df if metric is None else df.withColumn("_index", metric.index())


def _celled(
    first: DataFrame, keys: list[str], gate: Gate, coords: str, score: str | None, limit: int, metric: Metric | None
) -> DataFrame:
    """Rows with their index and cells, written out for the rounds."""
    if metric is None:
        return cut(with_cells(first, keys, gate, coords, score, limit))
    return cut(with_cells(_indexed(first, metric), keys, metric.index_gate(gate), "_index", score, limit))


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    gate: Gate,
    ident: str = "cand_id",
    coords: str = "coords",
    score: str | None = None,
    pairs: DataFrame | None = None,
    bound: int | None = None,
    group_limit: int | None = None,
    metric: Metric | None = None,
) -> DataFrame:
    """Drop each row that is alike to one already kept, in the given order.

    Likeness is the fixed-frame distance of ``coords``, another ``metric`` that
    tasks measure, or comes from listed ``pairs(keys, a, b, dist)``. ``bound``
    is a row count per key the caller has already enforced. Rows without finite
    coordinates are alike to none and stay; rows without a key go.
    """
    keys = list(keys)
    score = score if gate.score is not None else None
    df, odd = _sound(keyed(df, keys), coords, pairs)
    group_limit = group_limit or (GROUP_LIMIT if metric is None else metric.group_limit)
    small, large = split_by_size(df, keys, group_limit, bound)
    ordered = _indexed(rank(small, keys, order, "pos", bound=group_limit), metric)

    likeness = Likeness(gate, ident, coords, score, pairs is not None, metric)
    near_pairs = None if pairs is None else _in_range(pairs, gate)
    result = _follow(ordered, keys, ident, ordered.schema, _keeper(likeness), near_pairs, metric)
    result = result.drop("_index")
    if large is not None:
        placed = cut(rank(large, keys, order, "pos"))
        if pairs is None:
            same = [*keys, coords, *([score] if score else [])]
            first = placed.groupBy(*same).agg(F.min("pos").alias("pos"))
            state = _celled(first, keys, gate, coords, score, group_limit, metric)
            near, ends = by_distance(keys, gate, coords, score, group_limit, metric), None
            decide = _keeper(replace(likeness, ident="pos"))
        else:
            state = placed.select(*keys, "pos")
            ends = _present(near_pairs, placed, keys, ident)
            if score:
                scores = placed.select(*keys, "pos", score)
                ends = ends.join(
                    scores.withColumnsRenamed({"pos": "pos_a", score: "_sa"}), [*keys, "pos_a"]
                ).join(scores.withColumnsRenamed({"pos": "pos_b", score: "_sb"}), [*keys, "pos_b"])
                ends = ends.where(F.abs(F.col("_sa") - F.col("_sb")) < gate.score)
            ends = cut(ends.select(*keys, F.col("pos_a").alias("a"), F.col("pos_b").alias("b")))
            near, decide = by_pairs(ends, keys), _keeper(replace(likeness, ident="pos", score=None))
        kept = keep_in_prefixes(state, keys, near, decide, ends, group_limit, metric)
        result = result.unionByName(placed.join(shuffled(kept), [*keys, "pos"], "left_semi"))
    result = result.drop("pos")
    return result if odd is None else result.unionByName(odd)


def leader_cluster(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    gate: Gate,
    ident: str = "cand_id",
    coords: str = "coords",
    weight: str | None = None,
    pairs: DataFrame | None = None,
    bound: int | None = None,
    group_limit: int | None = None,
    metric: Metric | None = None,
) -> DataFrame:
    """Add ``cluster_id``, the id of the row's cluster centre.

    ``weight`` counts the copies a row stands for. Other arguments are those
    of ``keep_first``. Rows without finite coordinates are their own cluster.
    """
    keys = list(keys)
    df, odd = _sound(keyed(df, keys), coords, pairs)
    group_limit = group_limit or (GROUP_LIMIT if metric is None else metric.group_limit)
    small, large = split_by_size(df, keys, group_limit, bound)
    ordered = _indexed(rank(small, keys, order, "pos", bound=group_limit), metric)
    schema = T.StructType([*ordered.schema.fields, T.StructField("cluster_id", T.LongType())])

    likeness = Likeness(gate, ident, coords, None, pairs is not None, metric)
    decide = _clusterer(likeness, weight, "cluster_id")
    near_pairs = None if pairs is None else _in_range(pairs, gate)
    result = _follow(ordered, keys, ident, schema, decide, near_pairs, metric).drop("_index")
    if large is not None:
        placed = cut(rank(large, keys, order, "pos"))
        heavy = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
        decide = _clusterer(replace(likeness, ident="pos"), "weight", "centre")
        if pairs is None:
            # Copies share their neighbours, so one row stands for all of them.
            first = placed.groupBy(*keys, coords).agg(
                F.min("pos").alias("pos"), F.sum(heavy).alias("weight")
            )
            state = _celled(first, keys, gate, coords, None, group_limit, metric)
            near = by_distance(keys, gate, coords, None, group_limit, metric)
            centres = cluster_in_rounds(state, keys, near, decide, None, group_limit, metric)
            spots = state.join(shuffled(centres), [*keys, "pos"]).select(*keys, coords, "centre")
            members = placed.join(shuffled(spots), [*keys, coords])
        else:
            state = cut(placed.select(*keys, "pos", heavy.alias("weight")))
            ends = _present(near_pairs, placed, keys, ident)
            ends = cut(ends.select(*keys, F.col("pos_a").alias("a"), F.col("pos_b").alias("b")))
            near = by_pairs(ends, keys)
            centres = cluster_in_rounds(state, keys, near, decide, ends, group_limit)
            members = placed.join(shuffled(centres), [*keys, "pos"])
        names = placed.select(*keys, F.col("pos").alias("centre"), F.col(ident).alias("cluster_id"))
        result = result.unionByName(members.join(shuffled(names), [*keys, "centre"]).drop("centre"))
    result = result.drop("pos")
    if odd is None:
        return result
    return result.unionByName(odd.withColumn("cluster_id", F.col(ident).cast("bigint")))
