"""The whole candidate funnel as one composition of operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.functions.scalars import DEFAULTS, EV_TO_KCAL, finite
from candidate_funnel.operators.alignment import BestRmsd, fits, pack_symmetry
from candidate_funnel.operators.ensemble import assemble
from candidate_funnel.operators.graph import (
    induced,
    node_coords,
    strip_leaves,
    symmetry_guard,
)
from candidate_funnel.operators.greedy import keep_first, leader_cluster
from candidate_funnel.operators.neighbours import Gate
from candidate_funnel.operators.outcomes import funnel_report, outcomes
from candidate_funnel.operators.pool import apply_route
from candidate_funnel.operators.select import (
    converged,
    relative,
    representatives,
    top_k,
    within,
)
from candidate_funnel.operators.skew import HOT_ROWS, hot_join, largest_group
from candidate_funnel.operators.skew import keyed as keyed_rows
from candidate_funnel.session import cut


Metric = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Funnel:
    """The rows that survive each stage of a funnel."""

    keys: tuple[str, ...]
    pool: DataFrame
    routed: DataFrame
    whole: DataFrame
    scored: DataFrame
    converged: DataFrame
    sound: DataFrame
    even: DataFrame
    fitting: DataFrame
    measured: DataFrame
    in_window: DataFrame
    clusters: DataFrame
    selected: DataFrame
    rescored: DataFrame
    relaxed: DataFrame
    compared: DataFrame
    mapped: DataFrame
    unique: DataFrame
    ensemble: DataFrame

    def report(self) -> DataFrame:
        """Row counts per key and stage; the span is taken before the final cap."""
        stages = {
            "embedded": self.pool,
            "in_window": self.in_window,
            "clusters": self.clusters,
            "selected": self.selected,
            "relaxed": self.relaxed,
            "unique": self.unique,
        }
        return funnel_report(stages, self.keys, span=("unique", "rel"))

    def outcomes(self, keyed: DataFrame | None = None, strict: bool = False) -> DataFrame:
        """``ok`` or the first failing stage of every key in ``keyed``."""
        stages = {
            "no_candidate": self.pool,
            "null_key": keyed_rows(self.pool, self.keys),
            "no_route": self.routed,
            "malformed_graph": self.whole,
            "bad_score": self.scored,
            "none_converged_first": self.converged,
            "bad_coords": self.sound,
            "ragged_coords": self.even,
            "coords_mismatch": self.fitting,
            "empty_metric": self.measured,
            "mappings_mismatch": self.in_window,
            "bad_score_second": self.rescored,
            "none_converged_second": self.relaxed,
            "bad_coords_second": self.compared,
            "mappings_mismatch_second": self.mapped,
        }
        return outcomes(self.pool if keyed is None else keyed, stages, self.keys, strict)


def numeric(score: str) -> Column:
    """Whether a score is there and a number."""
    return F.col(score).isNotNull() & ~F.isnan(score)


def even_keys(df: DataFrame, keys: Sequence[str], vector: str, bound: int) -> DataFrame:
    """Rows of the keys whose vectors all have one length."""
    size = F.size(vector)
    if bound <= HOT_ROWS:
        whole = Window.partitionBy(*keys)
        sized = df.withColumn("_low", F.min(size).over(whole)).withColumn("_high", F.max(size).over(whole))
        return sized.where("_low = _high").drop("_low", "_high")
    sizes = df.groupBy(*keys).agg(F.min(size).alias("_low"), F.max(size).alias("_high"))
    return hot_join(df, sizes.where("_low = _high").select(*keys), keys, "left_semi")


def run_funnel(
    candidates: DataFrame,
    keys: Sequence[str],
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    cluster_metric: Metric | None = None,
    dedup_metric: Metric | None = None,
    mappings: DataFrame | None = None,
    cluster_mappings: DataFrame | None = None,
    dedup_mappings: DataFrame | None = None,
    align: bool = False,
    dims: int = 3,
    factor: float = 1.0,
    totals: DataFrame | None = None,
    window: float = DEFAULTS["window"],
    cluster_rmsd: float = DEFAULTS["cluster_rmsd"],
    max_selected: int = DEFAULTS["max_selected"],
    dedup_score: float = DEFAULTS["dedup_score"],
    dedup_rmsd: float = DEFAULTS["dedup_rmsd"],
    max_final: int = DEFAULTS["max_final"],
    bound: int | None = None,
    keep_stages: bool = True,
    cluster_symmetry: DataFrame | None = None,
    dedup_symmetry: DataFrame | None = None,
    prune_rmsd: float | None = None,
    routes: DataFrame | None = None,
    fallback: DataFrame | None = None,
    malformed: DataFrame | None = None,
) -> Funnel:
    """Narrow ``candidates(keys, cand_id, status, score, coords)`` to ensembles.

    ``scorer`` takes the selected rows to rows with ``score2`` and a boolean
    ``converged`` (and new ``coords``). Without one, an existing ``converged``
    column is used and the score carries over. The two metrics add a column
    ``metric`` with the coordinates that distances are measured on, for
    instance of heavy atoms or a stripped core; ensembles keep all atoms.
    ``mappings`` number the atoms of the metric from 0; where the two metrics
    measure different atoms, each takes its own (``cluster_mappings``,
    ``dedup_mappings``, or packed with exchangeable atoms: ``cluster_symmetry``,
    ``dedup_symmetry``). Keys whose mappings number other atoms go.
    With ``routes(keys, route)``, rows of keys routed to ``fallback`` come from
    that table, scored by a second model. ``prune_rmsd`` first drops candidates
    closer than that to one of a lower id. ``malformed(keys)`` lists keys whose
    graphs are not to be trusted. Rows without a number for a score, without finite
    coordinates, of keys with coordinates of several lengths, or whose
    coordinates end before an atom of the metric go, and ``outcomes`` says so.
    ``factor`` converts the first score to the unit of ``window``; the second
    is in eV. ``bound`` is a pool size per key that ``cap_per_key`` or
    ``expand`` has enforced; without it the largest key is counted once.
    ``keep_stages`` writes out the stages that reports share.
    """
    keys = list(keys)
    save = cut if keep_stages else (lambda df: df)
    if bound is None:
        bound = largest_group(candidates, keys)
    cluster_mappings = mappings if cluster_mappings is None else cluster_mappings
    dedup_mappings = mappings if dedup_mappings is None else dedup_mappings

    symmetry = [
        pack_symmetry(keys, m) if given is None else given
        for given, m in ((cluster_symmetry, cluster_mappings), (dedup_symmetry, dedup_mappings))
    ]

    pool = keyed_rows(candidates, keys)
    routed = pool if routes is None else save(apply_route(pool, fallback.select(pool.columns), routes, keys))
    whole = routed if malformed is None else hot_join(routed, malformed.select(*keys).distinct(), keys, "left_anti")
    if prune_rmsd is not None:
        prune = Gate(prune_rmsd, strict=True, dims=dims)
        whole = save(keep_first(whole, keys, ["cand_id"], prune, bound=bound))
    numbered = whole.where(numeric("score"))
    first = converged(numbered, "status")
    sound = first.where(finite("coords"))
    even = even_keys(sound, keys, "coords", bound)
    near = within(even, keys, "score", window, factor, bound)
    coords = "coords" if cluster_metric is None else "metric"
    fitting = near if cluster_metric is None else cluster_metric(near)
    fitting = fitting.where(F.col(coords).isNotNull())
    # Clustering reads its rows several times. Where mappings are to fit them, that would
    # be the whole way from the candidates each time.
    written = save if symmetry[0] is None else cut
    measured = written(fitting.where(F.size(coords) > 0))
    mapped_first, metric = _metric(measured, keys, symmetry[0], align, coords, dims, written)
    members = leader_cluster(
        mapped_first,
        keys,
        ["score", "cand_id"],
        Gate(cluster_rmsd, dims=dims),
        coords=coords,
        bound=bound,
        metric=metric,
    )
    clusters = save(representatives(members, keys, "cluster_id", "score", bound=bound))

    selected = top_k(clusters, keys, ["score", "cand_id"], max_selected).select(candidates.columns)
    if scorer is not None:
        scored = cut(scorer(selected))
    elif "converged" in candidates.columns:
        scored = selected.withColumn("score2", F.col("score"))
    else:
        scored = selected.withColumn("score2", F.col("score")).withColumn("converged", F.lit(True))

    # From here on max_selected bounds every key.
    rescored = scored.where(numeric("score2"))
    relaxed = converged(rescored, "converged")
    fit = relaxed.where(finite("coords"))
    fit = relative(
        even_keys(fit, keys, "coords", max_selected), keys, "score2", EV_TO_KCAL, "rel", max_selected
    )
    coords = "coords" if dedup_metric is None else "metric"
    compared = fit if dedup_metric is None else dedup_metric(fit)
    compared = compared.where(F.col(coords).isNotNull())
    mapped, metric = _metric(compared, keys, symmetry[1], align, coords, dims, lambda df: df)
    unique = save(
        keep_first(
            mapped,
            keys,
            ["score2", "cand_id"],
            Gate(dedup_rmsd, strict=True, score=dedup_score, dims=dims),
            coords=coords,
            score="rel",
            bound=max_selected,
            metric=metric,
        ).drop("metric")
    )
    ensemble = assemble(unique, keys, "score2", totals=totals, max_final=max_final)
    return Funnel(
        tuple(keys), candidates, routed, whole, numbered, first, sound, even, fitting, measured, mapped_first,
        clusters, selected, rescored, relaxed, compared, mapped, unique, ensemble,
    )


def guarded_metric(
    nodes: DataFrame,
    edges: DataFrame,
    mappings: DataFrame,
    key: str = "key",
    heavy: Column | None = None,
    cap: int = DEFAULTS["max_mappings"],
    dims: int = 3,
    swaps: DataFrame | None = None,
) -> tuple[Metric, DataFrame]:
    """The cluster metric under the symmetry guard, and the guard's report.

    Distances use the ``heavy`` nodes, or those without leaves for keys that
    reach ``cap`` mappings. Graphs carry the candidates' ``key`` as graph_id,
    and so do ``mappings``, one row per symmetry mapping, and ``swaps``, sets of
    exchangeable nodes that multiply them (``exchangeable_leaves``). The report has the
    numbers of measured, core and dropped nodes (``n_heavy, n_core, n_dropped``).
    """
    if heavy is not None:
        nodes, edges = induced(nodes, edges, heavy)
    core, _ = strip_leaves(nodes, edges)
    guard = symmetry_guard(nodes.select("graph_id"), mappings, ["graph_id"], cap, swaps)
    heavy_nodes = nodes.groupBy("graph_id").agg(F.count("*").alias("n_heavy"))
    core_nodes = core.groupBy("graph_id").agg(F.count("*").alias("n_core"))
    guard = guard.join(heavy_nodes, "graph_id", "left").join(core_nodes, "graph_id", "left")
    guard = guard.withColumn("n_core", F.coalesce("n_core", F.lit(0).cast("bigint")))
    dropped = F.when(F.col("use_core"), F.col("n_heavy") - F.col("n_core")).otherwise(F.lit(0))
    guard = guard.withColumn("n_dropped", dropped.cast("bigint"))

    def chosen(rows: DataFrame, use_core: bool) -> DataFrame:
        picked = guard.where(F.col("use_core") == use_core)
        return hot_join(rows.select("graph_id", "node_id"), picked, ["graph_id"], "left_semi")

    kept = chosen(nodes, False).unionByName(chosen(core, True)).withColumnRenamed("graph_id", key)
    return (lambda df: node_coords(df, [key], kept, dims=dims)), guard


def _metric(
    rows: DataFrame,
    keys: list[str],
    symmetry: DataFrame | None,
    align: bool,
    coords: str,
    dims: int,
    save: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, BestRmsd | None]:
    """Rows whose key's mappings fit its atoms, and the best RMSD under these.

    Without mappings or motion the plain distance serves: no metric.
    """
    if symmetry is None:
        return rows, (BestRmsd(coords, dims, align) if align else None)
    symmetry = save(symmetry)
    atoms = rows.groupBy(*keys).agg(F.max(F.size(coords) / dims).cast("int").alias("_atoms"))
    misfits = atoms.join(symmetry, keys).where(~fits(F.col("_atoms"))).select(*keys)
    fitting = save(hot_join(rows, misfits, keys, "left_anti"))
    usable = symmetry.join(misfits, keys, "left_anti")
    return fitting, BestRmsd(coords, dims, align, usable)


def guarded_symmetry(
    guard: DataFrame,
    mappings: DataFrame,
    core_mappings: DataFrame,
    swaps: DataFrame | None = None,
    core_swaps: DataFrame | None = None,
    key: str = "key",
) -> DataFrame:
    """The mappings that go with each key's guarded metric, packed.

    Keys on the core take ``core_mappings(graph_id, perm)``, the others
    ``mappings``, which number the measured atoms from 0 in node order. Those
    beyond the cap are left out before anything is gathered by key.
    """

    def chosen(listed: DataFrame | None, use_core: bool) -> DataFrame | None:
        if listed is None:
            return None
        return hot_join(listed, guard.where(F.col("use_core") == use_core).select("graph_id"), ["graph_id"], "left_semi")

    parts = [
        pack_symmetry(["graph_id"], chosen(m, core), chosen(b, core))
        for core, m, b in ((False, mappings, swaps), (True, core_mappings, core_swaps))
    ]
    return parts[0].unionByName(parts[1]).withColumnRenamed("graph_id", key)
