"""Hard negatives from exact inner products of Kronecker-packed vectors.

A vector's components become integers, ``floor(256 * x)``, biased so that none is
negative. The components of several candidates in one dimension are put into
separate fields of one wide integer; a multiplication by the anchor's component
then multiplies all of them, and a sum over the dimensions leaves one exact
product per field. A field is as wide as the largest product the table can
have. Wide integers are doubles where at least one field fits their 53 exact
bits (usual vectors: two fields), and integers without limit elsewhere.

1. *Tiles.* Anchors are dealt by hash into blocks, candidates into stripes. Every
   pair of a block and a stripe is one tile, whatever the labels are, so no
   label, however frequent, gathers in one task. Tiles are streamed: a task
   holds a block of anchors and one Arrow batch of candidates.
2. *Positives.* A tile keeps the best ``n_positives`` of the anchor's label; the
   best of all tiles are merged.
3. *Negatives.* Each positive's score bounds a band of scores; a second pass
   keeps the best ``n_negatives`` of other labels inside each band.

Defined results: rows with a null label or vector, or with a component that is
null or not finite, take no part. Equal rows (id, label, components) count once;
unlike rows of one id all take part, none being its own positive. Short vectors
end in zeros. A null id is never an anchor and loses every tie; it stands as the
largest long inside, which therefore is no id. Components and scores beyond the
range of a long stop at its ends. An empty table has no negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.session import cut

# Fixed values of the production query.
SCALE = 256
N_POSITIVES = 5
N_NEGATIVES = 3
# A negative's score in hundredths of the positive's.
BAND = (50, 95)

# Anchors a task holds, and candidates that one streams past them, on average.
BLOCK_ANCHORS = 16_384
STRIPE_ROWS = 16_384
# Candidates and anchors of one product; the first candidates of a tile come in
# smaller parts, as all of them rank among the best so far.
PART_ROWS = (64, 256, 1024, 4096)
PART_ANCHORS = 1024

NO_ID = (1 << 63) - 1
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
EXACT_BITS = 53


class Packing:
    """How vectors of ``dims`` components of at most ``bound`` are packed."""

    def __init__(self, dims: int, bound: int):
        self.dims, self.bias = max(dims, 1), bound + 1
        self.width = max(1, (self.dims * (2 * self.bias) ** 2).bit_length())
        self.fields = EXACT_BITS // self.width
        self.exact_doubles = self.fields > 0
        if not self.exact_doubles:
            self.fields = 4
        self.dtype = np.float64 if self.exact_doubles else object

    def biased(self, rows: np.ndarray) -> np.ndarray:
        whole = rows.astype(np.int64 if self.exact_doubles else object)
        return whole + self.bias

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Biased rows (n, dims) as ceil(n / fields) rows of wide integers."""
        groups = -(-len(rows) // self.fields)
        wide = np.zeros((groups, rows.shape[1]), dtype=rows.dtype)
        for field in range(self.fields):
            part = rows[field * groups : (field + 1) * groups]
            wide[: len(part)] += part * (1 << (self.width * field))
        return wide.astype(self.dtype)

    def unpack(self, products: np.ndarray, n: int) -> np.ndarray:
        """The field of each of the ``n`` packed rows, per anchor."""
        whole = products.astype(np.int64) if self.exact_doubles else products
        mask = (1 << self.width) - 1
        parts = [(whole >> (self.width * field)) & mask for field in range(self.fields)]
        return np.concatenate(parts, axis=1)[:, :n]

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of biased anchors and rows, as int64."""
        n = len(rows)
        products = anchors.astype(self.dtype) @ self.pack(rows).T
        fields = self.unpack(products, n)
        bias = self.bias * (anchors.sum(axis=1)[:, None] + rows.sum(axis=1)[None, :])
        exact = fields - bias + self.dims * self.bias**2
        return exact if self.exact_doubles else np.clip(exact, LEAST, MOST).astype(np.int64)


def matrix(values: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones ending in zeros."""
    lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(dims, 1)), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, np.arange(len(flat)) - first] = flat
    return out


class Tile:
    """A block of anchors and, for each of its bands, the best candidates so far.

    Candidates come by ascending id, so a later one needs a higher score.
    """

    def __init__(self, packing: Packing, same_label: bool, keep: int, rows: pa.Table):
        self.packing, self.same_label, self.keep = packing, same_label, keep
        # Sorted by label, the anchors of one label are a slice.
        self.rows = rows.sort_by("_label")
        labels = self.rows["_label"].combine_chunks().dictionary_encode()
        self.names = labels.dictionary
        self.label = labels.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.searchsorted(self.label, np.arange(len(self.names) + 1))
        self.ident = self.rows["_id"].to_numpy()
        self.key = self.rows["_key"].to_numpy()
        self.vectors = packing.biased(matrix(self.rows["_v"].combine_chunks(), packing.dims))
        bands = self.rows["_bands"].combine_chunks()
        n_bands = max((len(b) for b in bands), default=0)
        shape = (n_bands, self.rows.num_rows)
        # Anchors with fewer bands than others have empty ones.
        self.low, self.high = np.zeros(shape, dtype=np.int64), np.full(shape, -1, dtype=np.int64)
        for i, own in enumerate(bands.to_pylist()):
            for k, band in enumerate(own):
                self.low[k, i], self.high[k, i] = band["low"], band["high"]
        # A score must exceed ``bar`` to enter.
        self.bar = self.low - 1
        self.count = np.zeros(shape, dtype=np.int64)
        self.score = np.zeros((*shape, keep), dtype=np.int64)
        self.found = np.zeros((*shape, keep), dtype=np.int64)
        self.seen = 0

    def add(self, rows: pa.Table) -> None:
        at = 0
        while at < rows.num_rows:
            size = PART_ROWS[min(self.seen, len(PART_ROWS) - 1)]
            self.seen += 1
            self._part(rows.slice(at, size))
            at += size

    def _part(self, rows: pa.Table) -> None:
        ident, key = rows["_id"].to_numpy(), rows["_key"].to_numpy()
        codes = pa.compute.index_in(rows["_label"].combine_chunks(), value_set=self.names)
        label = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = self.packing.biased(matrix(rows["_v"].combine_chunks(), self.packing.dims))
        if self.same_label:
            for code in np.unique(label[label >= 0]).tolist():
                mine = np.nonzero(label == code)[0]
                self._compare(self.ends[code], self.ends[code + 1], ident[mine], key[mine], label[mine], vectors[mine])
        else:
            self._compare(0, len(self.label), ident, key, label, vectors)

    def _compare(self, start, stop, ident, key, label, vectors) -> None:
        for low in range(int(start), int(stop), PART_ANCHORS):
            high = min(low + PART_ANCHORS, int(stop))
            scores = self.packing.scores(self.vectors[low:high], vectors)
            for k in range(len(self.bar)):
                enters = (scores > self.bar[k, low:high, None]) & (scores <= self.high[k, low:high, None])
                i, j = np.nonzero(enters)
                if self.same_label:
                    right = (self.ident[low + i] != ident[j]) | (self.key[low + i] != key[j])
                else:
                    right = self.label[low + i] != label[j]
                i, j = i[right], j[right]
                if len(i):
                    self._enter(k, low + i, scores[i, j], ident[j])

    def _enter(self, k: int, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Merge new entries of a band with the ones held for the same anchors."""
        touched = np.unique(anchor)
        held = np.arange(self.keep)[None, :] < self.count[k, touched][:, None]
        anchors = np.concatenate([np.repeat(touched, self.keep)[held.ravel()], anchor])
        scores = np.concatenate([self.score[k, touched][held], score])
        idents = np.concatenate([self.found[k, touched][held], ident])
        order = np.lexsort((idents, -scores, anchors))
        anchors, scores, idents = anchors[order], scores[order], idents[order]
        starts = np.searchsorted(anchors, touched)
        place = np.arange(len(anchors)) - np.repeat(starts, np.diff(np.append(starts, len(anchors))))
        best = place < self.keep
        anchors, place = anchors[best], place[best]
        self.score[k, anchors, place] = scores[best]
        self.found[k, anchors, place] = idents[best]
        self.count[k, touched] = np.bincount(np.searchsorted(touched, anchors), minlength=len(touched))
        full = touched[self.count[k, touched] == self.keep]
        self.bar[k, full] = self.score[k, full, self.keep - 1]

    def result(self) -> pa.RecordBatch:
        held = np.arange(self.keep)[None, None, :] < self.count[:, :, None]
        band, anchor, _ = np.nonzero(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ident[anchor]), pa.array(self.key[anchor]), pa.array(band, pa.int32()),
                pa.array(self.score[held]), pa.array(self.found[held]),
            ],
            names=["_id", "_key", "_slot", "_score", "_found"],
        )


def best_in_tiles(
    anchors: DataFrame, rows: DataFrame, packing: Packing, same_label: bool, keep: int, blocks: int, stripes: int
) -> DataFrame:
    """(_id, _key, _slot, _score, _found): each band's best candidates, per tile.

    ``anchors`` has ``_bands``, a list of score ranges; ``_slot`` counts them.
    """
    own = F.pmod(F.xxhash64("_id", "_key"), F.lit(blocks)).cast("int")
    stripe = F.pmod(F.xxhash64("_id", "_key", F.lit(1)), F.lit(stripes)).cast("int")
    fields = ["_id", "_key", "_label", "_v", "_bands"]
    left = anchors.select(
        *fields, own.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_stripe"), F.lit(0).alias("_side")
    )
    right = rows.withColumn("_bands", F.lit(None).cast(anchors.schema["_bands"].dataType)).select(
        *fields, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), stripe.alias("_stripe"), F.lit(1).alias("_side")
    )
    tile = ["_block", "_stripe"]
    stream = left.unionByName(right).repartition(blocks * stripes, *tile).sortWithinPartitions(*tile, "_side", "_id", "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, tile_ = None, [], None
        for batch in batches:
            block, stripe_ = (batch.column(c).to_numpy() for c in ("_block", "_stripe"))
            side = batch.column("_side").to_numpy()
            turns = np.nonzero((np.diff(block) != 0) | (np.diff(stripe_) != 0) | (np.diff(side) != 0))[0] + 1
            table = pa.Table.from_batches([batch])
            for start, stop in zip([0, *turns.tolist()], [*turns.tolist(), len(block)], strict=True):
                if stop == start:
                    continue
                here = (block[start], stripe_[start])
                if here != at:
                    if tile_ is not None:
                        yield tile_.result()
                    at, waiting, tile_ = here, [], None
                part = table.slice(start, stop - start)
                if side[start] == 0:
                    waiting.append(part)
                    continue
                if tile_ is None:
                    if not waiting:
                        continue
                    tile_ = Tile(packing, same_label, keep, pa.concat_tables(waiting).combine_chunks())
                    waiting = []
                tile_.add(part)
        if tile_ is not None:
            yield tile_.result()

    return stream.mapInArrow(run, "_id bigint, _key bigint, _slot int, _score bigint, _found bigint")


def merged(parts: DataFrame, keep: int) -> DataFrame:
    """(_id, _key, _slot, _best): the best (score, id) of all tiles, in order."""
    # ``-_score`` first, so plain ordering puts the highest score first.
    entry = F.struct((-F.col("_score")).alias("minus"), F.col("_found").alias("found"))
    listed = parts.groupBy("_id", "_key", "_slot").agg(F.array_sort(F.collect_list(entry)).alias("_best"))
    return listed.withColumn("_best", F.slice("_best", 1, keep))


def quantised(rows: DataFrame, ident: str, label: str, vector: str) -> DataFrame:
    """(_id, _key, _label, _v): rows that take part, with integer components."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole = F.transform(
        x,
        lambda c: F.when(c * SCALE >= float(MOST), F.lit(MOST)).when(c * SCALE <= float(LEAST), F.lit(LEAST))
        .otherwise(F.floor(c * SCALE).cast("bigint")),
    )
    taken = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(sound)
    named = taken.select(
        F.coalesce(F.col(ident).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.col(label).cast("string").alias("_label"),
        whole.alias("_v"),
    ).distinct()
    return named.withColumn("_key", F.xxhash64("_label", "_v"))


def percent(whole: Column, hundredths: int) -> Column:
    """floor(whole * hundredths / 100) of a long that is not negative."""
    rest = F.pmod(whole, F.lit(100))
    return F.call_function("div", whole, F.lit(100)) * hundredths + F.floor(rest * hundredths / 100)


def mine(
    rows: DataFrame, anchor: Column, ident: str = "vec_id", label: str = "label", vector: str = "embedding",
    n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the id, named ``_id``, of the rows searched for.
    """
    held = cut(quantised(rows, ident, label, vector))
    size = held.agg(
        F.count("*"),
        F.coalesce(F.max(F.size("_v")), F.lit(0)),
        F.coalesce(F.max(F.array_max("_v")), F.lit(0)),
        F.coalesce(F.min(F.array_min("_v")), F.lit(0)),
        F.count(F.when(anchor & (F.col("_id") != NO_ID), 1)),
    ).first()  # one row
    n, dims, high, low, n_anchors = (int(v) for v in size)
    bound = max(high, -low)
    packing = Packing(dims, bound)
    blocks, stripes = max(1, -(-n_anchors // BLOCK_ANCHORS)), max(1, -(-n // STRIPE_ROWS))
    for narrow, limit in (("smallint", 1 << 15), ("int", 1 << 31)):
        if bound < limit:
            held = held.withColumn("_v", F.col("_v").cast(f"array<{narrow}>"))
            break
    anchors = held.where(anchor & (F.col("_id") != NO_ID))

    everything = F.array(F.struct(F.lit(LEAST + 1).alias("low"), F.lit(MOST).alias("high")))
    parts = best_in_tiles(anchors.withColumn("_bands", everything), held, packing, True, n_positives, blocks, stripes)
    positives = cut(merged(parts, n_positives).drop("_slot"))

    # low% * p <= 100 * q <= high% * p holds for no negative p.
    from_, to = BAND
    score = lambda b: -b["minus"]
    # Hundreds and the rest apart, so that no product leaves the range of long.
    bands = F.transform(
        "_best",
        lambda b: F.struct(
            F.when(score(b) < 0, 0).otherwise(-percent(score(b), -from_)).cast("bigint").alias("low"),
            F.when(score(b) < 0, -1).otherwise(percent(score(b), to)).cast("bigint").alias("high"),
        ),
    )
    banded = anchors.join(positives.withColumn("_bands", bands), ["_id", "_key"])
    parts = best_in_tiles(banded, held, packing, False, n_negatives, blocks, stripes)
    negatives = merged(parts, n_negatives)
    shown = lambda c: F.when(c != NO_ID, c)
    return (
        negatives.withColumnRenamed("_best", "_negatives")
        .join(positives, ["_id", "_key"])
        .select("_id", F.get("_best", F.col("_slot")).alias("_p"), F.posexplode("_negatives").alias("_at", "_n"))
        .select(
            F.col("_id").alias("anchor_id"),
            shown(F.col("_p")["found"]).alias("positive_id"),
            (F.col("_at") + 1).cast("int").alias("rank"),
            shown(F.col("_n")["found"]).alias("negative_id"),
            (-F.col("_p")["minus"]).alias("positive_score"),
            (-F.col("_n")["minus"]).alias("negative_score"),
        )
    )
