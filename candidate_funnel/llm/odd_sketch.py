"""MinHash near-duplicates with odd sketches, verified on full shingle sets.

1. *Signatures.* A text's words (A-Z in lower case) make its set of shingles,
   hashed to 64 bits. MinHash samples are banded: ``bands(similarity)`` bands of
   ``ROWS`` samples miss a pair at the threshold with a probability below 1e-7.
   Texts with one set (equal 128-bit digests) are one *node* from here on, their
   smallest id.
2. *Odd sketches.* All samples fold into a bitmap, each flipping one bit, so that
   only unequal samples are left in the XOR of two sketches and its population
   count estimates how similar the sets are.
3. *Candidates.* Each bucket of a band names one of its nodes, another in every
   band, and its members are paired with that one first. Pairs whose sketches
   say less than ``LOOSE`` are dropped, far below what the estimate can err.
   Where that leaves a bucket's members in several components, tiles compare
   the sketches of all its pairs that are apart, so that any pair sharing a
   bucket is sketched itself or in one component already. The connected
   components of all these links are *clusters*.
4. *Verification.* Clusters are dealt into blocks of at most ``BLOCK`` nodes, and
   all pairs of a block are compared on full sets as a product of incidence
   matrices. A block returns only links that join what was apart, fewer than
   it has nodes. Clusters of one block are done. Larger ones are dealt anew,
   which joins nearly all; then tiles compare every node outside of the
   cluster's main component with all nodes of other components, so no link is
   lost and the main component is never paired with itself.

Defined results: null, empty or blank texts have an empty set and are linked
with nothing; texts of fewer words than a shingle have one, the whole; rows of
one id are one document; a row without an id is linked with nothing and kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.llm.common import Memo, Plain, mix64, per_text
from candidate_funnel.llm.components import components
from candidate_funnel.session import cut

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 4
MISS = 1e-7
SKETCH_BITS = 512
LOOSE = 0.35
BLOCK = 160
SKETCH_BLOCK = 2000
DEALS = 2

_WORD = Memo(lambda w: xxhash.xxh3_64_intdigest(w))


def bands(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS))


def sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    out = []
    words = [t.lower().split() for t in texts]
    flat = np.array([_WORD[w] for ws in words for w in ws], dtype=np.uint64)
    odd = [np.uint64(x | 1) for x in mix64(np.arange(1, size + 1, dtype=np.uint64)).tolist()]
    mixed = np.zeros(max(len(flat) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        mixed += flat[k : k + len(mixed)] * odd[k]
    mixed = mix64(mixed)
    start = 0
    for ws in words:
        n = len(ws)
        if n >= size:
            out.append(np.unique(mixed[start : start + n - size + 1]))
        elif n:
            total = sum(int(flat[start + k]) * int(odd[k]) for k in range(n)) + n
            out.append(mix64(np.array([total % (1 << 64)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
        start += n
    return out


def signatures(all_sets: Sequence[np.ndarray], n_bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band values (texts, bands) and odd sketches (texts, bytes) of non-empty sets."""
    flat = np.concatenate(all_sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in all_sets])])[:-1]
    n = len(all_sets)
    keys = np.empty((n, n_bands), dtype=np.uint64)
    parity = np.zeros((n, SKETCH_BITS), dtype=bool)
    rows = np.arange(n)
    factor = mix64(np.arange(1000, 1000 + n_bands * ROWS, dtype=np.uint64)) | np.uint64(1)
    for b in range(n_bands):
        key = np.full(n, b, dtype=np.uint64)
        for r in range(ROWS):
            j = b * ROWS + r
            least = np.minimum.reduceat(flat * factor[j], starts)
            key = mix64(key * np.uint64(31) + least)
            bit = mix64(least + np.uint64(j)) % np.uint64(SKETCH_BITS)
            parity[rows, bit.astype(np.int64)] ^= True
        keys[:, b] = key
    return keys, np.packbits(parity, axis=1)


def estimate(differing: F.Column, samples: int) -> F.Column:
    """Similarity by the number of differing sketch bits."""
    share = F.least(differing * 2 / F.lit(SKETCH_BITS), F.lit(0.999999))
    return 1 + F.lit(SKETCH_BITS / (4 * samples)) * F.log(1 - share)


def differing_most(similarity: float, samples: int) -> int:
    """Differing sketch bits up to which ``estimate`` says ``similarity`` or more."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp((similarity - 1) * 4 * samples / SKETCH_BITS)))


def differing(a: str, b: str) -> F.Column:
    """Population count of the XOR of two sketches held as arrays of longs."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")),
        F.lit(0),
        lambda s, x: s + x,
    )


def sign(docs: DataFrame, id_column: str, text: str, size: int, n_bands: int) -> DataFrame:
    """(_id, n_shingles, digest, keys, sketch) per row."""

    def work(texts: list[bytes]) -> list[pa.Array]:
        own = sets(texts, size)
        full = [i for i, s in enumerate(own) if len(s)]
        n = np.array([len(s) for s in own], dtype=np.int64)
        digest: list = [None] * len(texts)
        keys: list = [None] * len(texts)
        sketch: list = [None] * len(texts)
        if full:
            made, folded = signatures([own[i] for i in full], n_bands)
            for k, i in enumerate(full):
                digest[i] = xxhash.xxh3_128_digest(own[i].tobytes())
                keys[i] = made[k].view(np.int64)
                sketch[i] = folded[k].view(np.int64)
        longs = pa.list_(pa.int64())
        return [pa.array(n), pa.array(digest, pa.binary()), pa.array(keys, longs), pa.array(sketch, longs)]

    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_t"))
    fields = "n_shingles bigint, digest binary, keys array<bigint>, sketch array<bigint>"
    return per_text(rows, "_t", work, fields, ["_id"])


def clusters(nodes: DataFrame, n_bands: int) -> DataFrame:
    """(node, root) of nodes that share a bucket with a node not far from them.

    Any two nodes of a bucket whose sketches say ``LOOSE`` or more have one root.
    """
    each = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    named = each.groupBy("band", "key").agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.xxhash64("node", "band").alias("h"), F.col("node").alias("rep"))).alias("m"),
    )
    named = cut(named.where("n > 1").select("band", "key", F.col("m.rep").alias("rep")))
    met = cut(each.join(named, ["band", "key"]).select("band", "key", "node", "rep"))
    pairs = met.where("node <> rep").select("node", "rep").distinct()
    light = nodes.select("node", "sketch")
    other = light.select(F.col("node").alias("rep"), F.col("sketch").alias("other"))
    close = estimate(differing("sketch", "other"), n_bands * ROWS) >= LOOSE
    near = pairs.join(light, "node").join(other, "rep").where(close)
    first = cut(components(near.select("node", "rep"), "node", "rep"))
    # Members that the named node left apart meet each other; a key holds its band.
    placed = met.select(F.col("key").alias("cluster"), "node").join(first, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    sent = tiles(placed, SKETCH_BLOCK).join(light.withColumnRenamed("sketch", "shingles"), "node")
    most = differing_most(LOOSE, n_bands * ROWS)
    more = cut(verify(sent, lambda ids, roots, own: alike(ids, roots, own, most)))
    if more.isEmpty():
        return first
    return cut(components(first.select("node", "root").union(more), "node", "root"))


class Roots:
    """Union-find over a block's nodes."""

    def __init__(self, labels: list):
        self.up = {x: x for x in labels}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def links(ids: list[int], roots: list[int], own: list[np.ndarray], hundredths: int) -> list[tuple[int, int]]:
    """Links between nodes of different roots that join what was apart."""
    n = len(ids)
    if n < 2 or len(set(roots)) < 2:
        return []
    sizes = np.array([len(s) for s in own], dtype=np.int64)
    flat = np.concatenate(own)
    owner = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # shingles of a single node meet nothing
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.r_[0, np.diff(column[order]) != 0]) if len(order) else column
    common = np.zeros((n, n), dtype=np.int64)
    step = 4096
    top = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, top + step, step))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        m = np.zeros((n, step), dtype=np.float32)
        m[owner[part], column[part] - k * step] = 1
        common += (m @ m.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    close = np.triu(100 * common >= hundredths * union, 1)
    groups = Roots(sorted(set(roots)))
    return [
        (ids[i], ids[j])
        for i, j in zip(*np.nonzero(close), strict=True)
        if groups.join(roots[i], roots[j])
    ]


def alike(ids: list[int], roots: list[int], own: list[np.ndarray], most: int) -> list[tuple[int, int]]:
    """As ``links``, of nodes whose sketches differ in at most ``most`` bits."""
    n = len(ids)
    if n < 2 or len(set(roots)) < 2:
        return []
    groups = Roots(sorted(set(roots)))
    held = np.stack(own)
    top = np.array(roots)
    out = []
    for i in range(n - 1):
        apart = i + 1 + np.flatnonzero(top[i + 1 :] != top[i])
        bits = np.bitwise_count(held[apart] ^ held[i]).sum(axis=1, dtype=np.int64)
        out += [(ids[i], ids[j]) for j in apart[bits <= most].tolist() if groups.join(roots[i], roots[j])]
    return out


def verify(members: DataFrame, compare: Callable) -> DataFrame:
    """(a, b): links found inside groups of (group, node, root, shingles) rows.

    ``compare`` gets a group's nodes, roots and sets (or sketches). Rows are dealt by ``group`` and sorted; a task holds one group at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, roots, own, found = None, [], [], [], []
        for batch in batches:
            groups, nodes, tops, raw = (batch.column(i).to_pylist() for i in range(4))
            for g, node, root, s in zip(groups, nodes, tops, raw, strict=True):
                if g != held:
                    found += compare(ids, roots, own)
                    held, ids, roots, own = g, [], [], []
                ids.append(node)
                roots.append(root)
                own.append(np.frombuffer(s, dtype=np.uint64) if isinstance(s, bytes) else np.array(s, dtype=np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["a", "b"])
                found = []
        found += compare(ids, roots, own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["a", "b"])

    dealt = members.select("group", "node", "root", "shingles").repartition("group")
    return dealt.sortWithinPartitions("group").mapInArrow(work, "a bigint, b bigint")


def joined(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the roots of all links found so far."""
    roots = components(found).select("node", F.col("root").alias("_r"))
    plain = members.drop("root").join(roots, "node", "left")
    return plain.withColumn("root", F.coalesce("_r", "node")).drop("_r")


def tiles(now: DataFrame, block: int) -> DataFrame:
    """(cluster, node, root) rows dealt by ``group`` into tiles of at most about
    ``block`` nodes, in which all nodes of one cluster and different roots meet."""
    counts = now.groupBy("cluster", "root").agg(F.count("*").alias("_c"))
    main = counts.groupBy("cluster").agg(
        F.max(F.struct("_c", "root")).alias("m"), F.sum("_c").alias("_all")
    )
    main = main.select("cluster", F.col("m.root").alias("_main"), (F.col("_all") - F.col("m._c")).alias("_rest"), F.col("m._c").alias("_most"))
    now = now.join(cut(main.where("_rest > 0")), "cluster")
    half = block // 2
    rest_blocks = F.ceil(F.col("_rest") / half).cast("int")
    main_blocks = F.ceil(F.col("_most") / half).cast("int")
    outside = F.col("root") != F.col("_main")
    own = F.pmod(F.xxhash64("node", F.lit(99)), F.when(outside, rest_blocks).otherwise(main_blocks)).cast("int")
    now = now.withColumn("_own", own)
    # Tiles (i, j): i a block outside; j >= 0 one of the main component, j < 0 one outside.
    with_main = F.transform(F.sequence(F.lit(0), main_blocks - 1), lambda j: F.struct(F.col("_own").alias("i"), j.alias("j")))
    with_rest = F.transform(
        F.sequence(F.lit(0), rest_blocks - 1),
        lambda j: F.struct(F.least(j, F.col("_own")).alias("i"), (-1 - F.greatest(j, F.col("_own"))).alias("j")),
    )
    from_main = F.transform(F.sequence(F.lit(0), rest_blocks - 1), lambda i: F.struct(i.alias("i"), F.col("_own").alias("j")))
    dealt = F.when(outside, F.concat(with_main, with_rest)).otherwise(from_main)
    sent = now.withColumn("_tile", F.explode(dealt))
    return sent.withColumn("group", F.xxhash64("cluster", "_tile.i", "_tile.j"))


def all_links(members: DataFrame, hundredths: int) -> DataFrame:
    """(a, b): links that span the components of (node, cluster, _n, shingles) rows;
    ``_n`` is the number of nodes of the row's cluster."""
    members = members.withColumn("root", F.col("node"))
    block = F.pmod(F.xxhash64("node", F.lit(0)), F.ceil(F.col("_n") / (BLOCK * 0.75)))
    group = F.xxhash64("cluster", F.when(F.col("_n") <= BLOCK, 0).otherwise(block))

    def compare(ids: list[int], roots: list[int], own: list[np.ndarray]) -> list[tuple[int, int]]:
        return links(ids, roots, own, hundredths)

    found = cut(verify(members.withColumn("group", group), compare))
    large = members.where(F.col("_n") > BLOCK)
    if large.isEmpty():
        return found
    for deal in range(1, DEALS):
        block = F.pmod(F.xxhash64("node", F.lit(deal)), F.ceil(F.col("_n") / (BLOCK * 0.75)))
        more = verify(large.withColumn("group", F.xxhash64("cluster", block)), compare)
        found = cut(found.union(more))
    # Every node outside of its cluster's main component against all others.
    return found.union(cut(verify(tiles(joined(large, found), BLOCK), compare)))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    shingle: int = SHINGLE, similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Documents are linked where the Jaccard similarity of their sets is at least
    ``similarity`` (in hundredths); ``component_id`` is the smallest id reachable.
    """
    n_bands = bands(similarity)
    hundredths = round(similarity * 100)
    rows = cut(sign(docs, id_column, text, shingle, n_bands))
    full = rows.where("digest is not null and _id is not null")
    # One node per set, its smallest id.
    firsts = full.groupBy("digest").agg(F.min("_id").alias("node"), F.min_by("keys", "_id").alias("keys"), F.min_by("sketch", "_id").alias("sketch"))
    firsts = cut(firsts)
    cluster = clusters(firsts, n_bands)
    # The root of a cluster is a node of it too.
    cluster = cluster.union(cluster.select("root", "root")).distinct()
    cluster = cut(cluster.withColumnRenamed("root", "cluster"))
    sizes = cut(cluster.groupBy("cluster").agg(F.count("*").alias("_n")))
    cluster = cluster.join(sizes, "cluster")

    def work(texts: list[bytes]) -> list[pa.Array]:
        own = sets(texts, shingle)
        return [
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()),
            pa.array([s.tobytes() for s in own], pa.large_binary()),
        ]

    held = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text).alias("_t"))
    held = held.join(cluster, "node")
    members = per_text(held, "_t", work, "digest binary, shingles binary", ["node", "cluster", "_n"])
    # An id may stand for several texts; each set is a member once.
    members = cut(members.dropDuplicates(["node", "digest"]).where("length(shingles) > 0").drop("digest"))
    found = all_links(members, hundredths)
    placed = rows.join(firsts.select("digest", "node"), "digest", "left")
    # An id of several texts links their sets.
    several = placed.where("node is not null").groupBy("_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    several = cut(several.where("lo < hi"))
    own = placed.join(several, "_id").where("node > lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    top = components(found.union(own)).withColumnRenamed("root", "_root")
    out = placed.join(top, "node", "left")
    component = F.coalesce("_root", "node", "_id")
    component = F.when(F.col("digest").isNotNull() & F.col("_id").isNotNull(), component).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_column),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per group of near-duplicates, the one of the smallest id.

    Of several rows of one id the first by text stays; rows without an id all do.
    """
    plain = Plain(docs)
    own, held = plain.name(id_column), plain.name(text)
    found = near_duplicates(docs.select(id_column, text), id_column, text)
    stays = found.where(F.col(id_column).isNotNull() & F.col("kept")).select(F.col(id_column).alias(own))
    rows = plain.frame.where(F.col(own).isNotNull()).join(stays.distinct(), own, "left_semi")
    first = Window.partitionBy(own).orderBy(held)
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*plain.names)
    return plain.back(rows.union(plain.frame.where(F.col(own).isNull())))
