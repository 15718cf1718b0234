"""Benchmark decontamination by SimHash over windows sized by the items.

1. Benchmark items are grouped by length, lengths of one group differing by
   less than a third. A group's window is three quarters of the longest run of
   words that a near copy of its shortest item must keep whole (``whole_run``),
   and every window of every item is fingerprinted: 64 bits, each the sign of
   the sum of +-1 over the window's words, weighted by how rare a word is among
   the items.
2. A document is fingerprinted at a stride: a run kept whole has at least as many
   windows as the stride is long, so one of them is met exactly, wherever the
   copy starts. Copies with several changes are met within the radius.
3. Multi-index Hamming blocks: 64 bits are four blocks of 16. Two fingerprints
   within ``RADIUS`` bits agree in some block but for ``RADIUS // 4`` bits, and
   the tables list items under all such block values. Thus no fingerprint
   within the radius is missed; the rest of each bucket is discarded by XOR and
   population count.
4. A candidate is verified exactly: of all stretches of the document around the
   window, the one of the highest weighted Jaccard similarity of five-word
   shingles, whatever its length. Shingle weights are the rarity of the shingle
   among the items; shingles that the item lacks weigh as much as the rarest.

The benchmark is a stated query set. Up to ``BLOCK_BYTES`` of it are one block. A
larger one is read in blocks of that size, one pass over the documents after the
other: the driver and the tasks hold one block at a time, with the rarities of
its words and shingles counted over the whole benchmark.

Defined results: null or empty texts hold nothing; an item without words is
never found; items shorter than five words are one shingle; equal items are all
reported; every input row gets one row.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidate_funnel.llm.common import Memo, Plain, per_text
from candidate_funnel.session import cut, discard

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 11
BLOCKS = 4
# Part of a run kept whole that a window covers.
WINDOW = 0.75
# What a similarity may lack by rounding.
SLIP = 1e-9
# Bytes of item texts that one pass over the documents looks for.
BLOCK_BYTES = 2 << 20
# Tables of finds that are read together.
MOST_PARTS = 64
# Words of texts whose sums are held at once, and words whose signs are kept.
PART_WORDS = 40_000
MOST_WORDS = 150_000


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def bits(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(w: Sequence[bytes]) -> list[tuple]:
    """Runs of five words; a shorter, non-empty text is one run."""
    if not w:
        return []
    return [tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]


def run_bits(run: tuple) -> int:
    """Hash of a shingle, apart from those of words."""
    return bits(b" " + b" ".join(run))


def tokens_of(w: list[bytes]) -> set[int]:
    """Hashes of the distinct words and shingles of an item."""
    return {bits(x) for x in w} | {run_bits(s) for s in shingles(w)}


def whole_run(least: int, longest: int, similarity: float) -> int:
    """Words that a copy of an item of ``least`` words or more keeps in one run.

    A copy cut at its ends keeps the share ``similarity`` of the shingles. A
    word put into the middle costs ``SHINGLE - 1`` shingles and adds ``SHINGLE``;
    items long enough for that (``longest`` is) keep at least one half.
    """
    if least < SHINGLE:
        return least
    most = longest - SHINGLE + 1
    if SHINGLE - 1 + SHINGLE * similarity <= most * (1 - similarity):
        return max(SHINGLE, (least - 1) // 2)
    return min(least, math.ceil(similarity * (least - SHINGLE + 1)) + SHINGLE - 1)


def near_values(radius: int) -> np.ndarray:
    """All 16-bit patterns of at most ``radius`` ones."""
    values = np.arange(1 << 16, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


class Index:
    """Items of one block, by length group, with their fingerprints and tables."""

    def __init__(
        self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY,
        n: int | None = None, counts: dict[int, int] | None = None,
    ):
        """``n`` items hold words in the whole benchmark, ``counts`` of them each
        token of ``tokens_of``; left out, ``items`` are the whole benchmark."""
        self.similarity = similarity
        self.items = [(i, words(t)) for i, t in items if t and words(t)]
        if counts is None:
            n = len(self.items)
            counts = Counter(h for _, ws in self.items for h in tokens_of(ws))
        # Words of no item weigh as much as the rarest.
        own = {w for _, ws in self.items for w in ws}
        self.word_weight = {w: int(round(4 * math.log2(1 + n / counts[bits(w)]))) for w in own}
        self.other = int(round(4 * math.log2(1 + n))) or 4
        self.bags = [Counter(shingles(ws)) for _, ws in self.items]
        self.shingle_weight = {s: math.log2(1 + n / counts[run_bits(s)]) for bag in self.bags for s in bag}
        self.shingle_other = math.log2(1 + n) if n else 1.0
        self.total = [sum(self.shingle_weight[s] * k for s, k in bag.items()) for bag in self.bags]
        longest = max((len(ws) for _, ws in self.items), default=0)
        wide = longest * max(self.other, 4 * math.ceil(math.log2(1 + max(n, 1)))) >= 1 << 15
        self.kind = np.int32 if wide else np.int16
        self.memo, self.known, self.rows = None, 0, None
        self.groups = []
        left = sorted(range(len(self.items)), key=lambda i: len(self.items[i][1]))
        while left:
            least = len(self.items[left[0]][1])
            group = [i for i in left if len(self.items[i][1]) < least * 1.33]
            left = left[len(group) :]
            run = whole_run(least, len(self.items[group[-1]][1]), similarity)
            window = max(1, int(run * WINDOW))
            self.groups.append(self._group(group, window, run - window + 1))

    def _group(self, group: list[int], window: int, stride: int) -> tuple:
        prints, owner, offset = [], [], []
        for i in group:
            made = self.simhash(*self.signs([self.items[i][1]]), window, 1)[0]
            prints.append(made)
            owner += [i] * len(made)
            offset += range(len(made))
        prints = np.concatenate(prints)
        tables = []
        near = near_values(RADIUS // BLOCKS)
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint32)
            keys = (value[:, None] ^ near[None, :]).ravel()
            rows = np.repeat(np.arange(len(prints)), len(near))
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << 16) + 1))
            tables.append((starts, rows[order].astype(np.int32)))
        return window, stride, prints, np.array(owner), np.array(offset), tables

    def enlist(self, word: bytes) -> int:
        """Row of a word's weighted signs; ``settle`` fills it in."""
        self.new.append(bits(word))
        self.new_weight.append(self.word_weight.get(word, self.other))
        return self.known + len(self.new) - 1

    def settle(self) -> None:
        hashes = np.array(self.new, dtype=np.uint64)
        made = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        made = made.astype(self.kind)
        made *= 2
        made -= 1
        made *= np.array(self.new_weight, dtype=self.kind)[:, None]
        while self.known + len(made) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.known : self.known + len(made)] = made
        self.known += len(made)
        self.new, self.new_weight = [], []

    def signs(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of weighted signs over all words, and where texts end.

        The sums wrap around at 16 bits; differences over a window, below 2^15 as
        long as weights stay below ``2^15 / words``, come out right all the same.
        """
        if self.memo is None or self.known > MOST_WORDS:
            # Started afresh between parts only, so rows in use stay.
            self.memo, self.known = Memo(self.enlist, 1 << 62), 0
            self.new, self.new_weight = [], []
            self.rows = np.empty((1024, 64), dtype=self.kind)
        flat = np.array([self.memo[w] for ws in texts for w in ws], dtype=np.int64)
        if self.new:
            self.settle()
        total = np.zeros((len(flat) + 1, 64), dtype=self.kind)
        np.cumsum(self.rows[flat], axis=0, out=total[1:], dtype=self.kind)
        return total, np.concatenate([[0], np.cumsum([len(ws) for ws in texts])]).astype(np.int64)

    @staticmethod
    def simhash(total, ends, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints at a stride and their first word; a text shorter than the
        window is one window, and the last window always ends with the text."""
        starts, stops = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a == b:
                continue
            s = np.arange(a, max(a + 1, b - window + 1), stride)
            if b - window > s[-1]:
                s = np.append(s, b - window)
            starts.append(s)
            stops.append(np.minimum(s + window, b))
        if not starts:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        first, stop = np.concatenate(starts), np.concatenate(stops)
        out = []
        for i in range(0, len(first), 1 << 14):
            diff = total[stop[i : i + (1 << 14)]] - total[first[i : i + (1 << 14)]]
            out.append(np.packbits(diff > 0, axis=1, bitorder="little").view(np.uint64).ravel())
        return np.concatenate(out), first

    def candidates(self, texts: list[list[bytes]]) -> dict[int, set[tuple[int, int]]]:
        """By text: (item, word at which the item would start), within the radius."""
        found: dict[int, set] = {}
        total, ends = self.signs(texts)
        for window, stride, prints, owner, offset, tables in self.groups:
            made, first = self.simhash(total, ends, window, stride)
            for b, (starts, rows) in enumerate(tables):
                value = ((made >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                lo = starts[value]
                n = starts[value + 1] - lo
                for i in range(0, len(made), 1 << 16):
                    m = n[i : i + (1 << 16)]
                    if not m.any():
                        continue
                    which = np.repeat(np.arange(i, i + len(m)), m)
                    base = np.repeat(lo[i : i + (1 << 16)] - np.cumsum(m) + m, m)
                    row = rows[base + np.arange(len(which))]
                    close = np.bitwise_count(made[which] ^ prints[row]) <= RADIUS
                    for w, r in zip(which[close].tolist(), row[close].tolist(), strict=True):
                        at = int(first[w])
                        d = int(np.searchsorted(ends, at, side="right")) - 1
                        found.setdefault(d, set()).add((int(owner[r]), at - int(ends[d]) - int(offset[r])))
        return found

    def likeness(self, item: int, part: list[bytes]) -> float:
        """Weighted Jaccard similarity of an item's and a stretch's shingles."""
        bag, other = self.bags[item], Counter(shingles(part))
        both = either = 0.0
        for s in bag.keys() | other.keys():
            weight = self.shingle_weight[s] if s in bag else self.shingle_other
            both += weight * min(bag[s], other[s])
            either += weight * max(bag[s], other[s])
        return both / either

    def best(self, item: int, part: list[bytes]) -> float:
        """Highest likeness of an item to any stretch of ``part``, 0 below the bar.

        A ratio is reached where the sum of shared weight less the ratio times
        foreign weight is; the stretch of the largest such sum gives the next
        ratio, until it grows no more.
        """
        own = self.items[item][1]
        if len(own) < SHINGLE:
            n = len(own)
            return float(any(part[a : a + n] == own for a in range(len(part) - n + 1)))
        bag, total = self.bags[item], self.total[item]
        bar = self.similarity - SLIP
        made = shingles(part)
        held = Counter(s for s in made if s in bag)
        if sum(self.shingle_weight[s] * min(n, bag[s]) for s, n in held.items()) < bar * total:
            return 0.0
        shared = np.array([self.shingle_weight[s] if s in bag else 0.0 for s in made])
        foreign = np.where(shared > 0, 0.0, self.shingle_other)
        ratio, found, at = bar, 0.0, (0, 0)
        while True:
            run = np.concatenate([[0.0], np.cumsum(shared - ratio * foreign)])
            stop = int(np.argmax(run - np.minimum.accumulate(run)))
            start = int(np.argmin(run[: stop + 1]))
            value = float(shared[start:stop].sum() / (total + foreign[start:stop].sum()))
            if value <= found + SLIP:
                break
            ratio = found = value
            at = start, stop
        if found < bar:
            return 0.0
        if all(n <= bag[s] for s, n in Counter(s for s in made[at[0] : at[1]] if s in bag).items()):
            return min(found, 1.0)
        # A shingle occurs more often than in the item: only so many count, from
        # each possible start on.
        places: dict[tuple, list[int]] = {}
        before = np.full(len(made), -1)
        for j, s in enumerate(made):
            if s in bag:
                seen = places.setdefault(s, [])
                seen.append(j)
                if len(seen) > bag[s]:
                    before[j] = seen[-1 - bag[s]]
        found = 0.0
        for i in np.flatnonzero(shared).tolist():
            counts = before[i:] < i
            both = np.cumsum(np.where(counts, shared[i:], 0.0))
            rest = np.cumsum(np.where(counts, foreign[i:], shared[i:] + foreign[i:]))
            found = max(found, float((both / (total + rest)).max()))
        return min(found, 1.0) if found >= bar else 0.0

    def verify(self, ws: list[bytes], pairs: set[tuple[int, int]]) -> dict[int, float]:
        """Best similarity by item, where it is high enough."""
        starts: dict[int, list[int]] = {}
        for item, start in pairs:
            starts.setdefault(item, []).append(start)
        out: dict[int, float] = {}
        for item, at in starts.items():
            size = len(self.items[item][1])
            # No stretch that is alike enough has more foreign shingles than this.
            slack = int(size * (1 / self.similarity - 1)) + 1
            regions: list[list[int]] = []
            for start in sorted(at):
                a, b = max(0, start - slack), min(len(ws), start + size + slack)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = max(b, regions[-1][1])
                else:
                    regions.append([a, b])
            value = max(self.best(item, ws[a:b]) for a, b in regions)
            if value:
                out[item] = value
        return out

    def search(self, texts: list[bytes]) -> list[list[tuple[int, float]]]:
        """By text: (item id, similarity) of the items it holds, by id, null first."""
        cut = [words(t) for t in texts]
        out = [[] for _ in texts]
        if not self.groups:
            return out
        start = 0
        while start < len(cut):
            stop, held = start + 1, len(cut[start])
            while stop < len(cut) and held + len(cut[stop]) <= PART_WORDS:
                held += len(cut[stop])
                stop += 1
            for d, pairs in self.candidates(cut[start:stop]).items():
                best = self.verify(cut[start + d], pairs)
                hits = [(self.items[i][0], v) for i, v in best.items()]
                out[start + d] = sorted(hits, key=lambda h: (h[0] is not None, h[0] or 0, h[1]))
            start = stop
        return out


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written, with a number of each row."""
    return cut(df.withColumn("_row", F.monotonically_increasing_id()))


def rarities(items: DataFrame) -> DataFrame:
    """(_row, tokens): of each row of (_row, _t), how many rows hold each token."""

    def work(texts: list[bytes]) -> list[pa.Array]:
        made = [sorted(np.array(list(tokens_of(words(t))), dtype=np.uint64).view(np.int64).tolist()) for t in texts]
        return [pa.array(made, pa.list_(pa.int64()))]

    held = cut(
        per_text(items, "_t", work, "tokens array<bigint>", ["_row"]).select("_row", F.explode("tokens").alias("token"))
    )
    # Written, so that adaptive execution can split what a frequent token meets.
    counts = cut(held.groupBy("token").agg(F.count("*").alias("n")))
    return held.join(counts, "token").groupBy("_row").agg(F.collect_list(F.struct("token", "n")).alias("tokens"))


def blocks(benchmark: DataFrame, id_column: str, text: str) -> Iterator[tuple]:
    """(items, n, counts) for ``Index``, block by block of ``BLOCK_BYTES`` of text.

    The driver holds one block, and one partition of the sorted items, at a time.
    """
    t = F.col(f"`{text}`").cast("string")
    items = benchmark.select(F.col(f"`{id_column}`").alias("_item"), t.alias("_t"))
    items = items.where(F.col("_t").rlike(r"[^\x20\x09-\x0D]"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    if size <= BLOCK_BYTES:
        rows = items.select("_item", F.col("_t").cast("binary")).orderBy("_item", "_t").collect()
        yield [(i, bytes(t)) for i, t in rows], None, None
        return
    items = numbered(items)
    n = items.count()
    rows = items.join(rarities(items), "_row").select("_item", F.col("_t").cast("binary"), "tokens")
    rows = cut(rows.repartitionByRange(max(1, size // BLOCK_BYTES), "_item", "_t").sortWithinPartitions("_item", "_t"))
    held, counts, bulk = [], {}, 0
    for item, t, tokens in rows.orderBy("_item", "_t").toLocalIterator():
        if held and bulk + len(t) > BLOCK_BYTES:
            yield held, n, counts
            held, counts, bulk = [], {}, 0
        held.append((item, bytes(t)))
        counts.update((h % (1 << 64), c) for h, c in tokens)
        bulk += len(t)
    yield held, n, counts
    discard(rows, items)


def find(
    docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
    similarity: float = SIMILARITY, item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Columns ``keep`` and ``hits``, an array of (item_id, similarity) by item id."""
    hit = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())])
    fields = "array<struct<item_id:bigint,similarity:double>>"
    context = docs.sparkSession.sparkContext

    def searched(rows: DataFrame, column: str, block: tuple, names: Sequence[str]):
        shared = context.broadcast((uuid.uuid4().hex, similarity, *block))

        def work(texts: list[bytes]) -> list[pa.Array]:
            rows = _INDEX.get(shared).search(texts)
            return [pa.array([[{"item_id": i, "similarity": v} for i, v in r] for r in rows], pa.list_(hit))]

        return per_text(rows, column, work, f"hits {fields}", names), shared

    kept = docs.select(*keep, F.col(text).cast("string").alias("_held"))
    each = blocks(benchmark, item_id, item_text)
    block, following = next(each), next(each, None)
    if following is None:
        return searched(kept, "_held", block, list(keep))[0]
    rows = numbered(kept)
    parts: list[DataFrame] = []
    while block is not None:
        made, shared = searched(rows, "_held", block, ["_row"])
        parts.append(cut(made.select("_row", F.explode("hits").alias("hit"))))
        shared.destroy()
        if len(parts) == MOST_PARTS:
            merged = cut(reduce(DataFrame.union, parts))
            discard(*parts)
            parts = [merged]
        block, following = following, next(each, None)
    found = reduce(DataFrame.union, parts).groupBy("_row").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    none = F.array().cast(fields)
    return rows.join(found, "_row", "left").select(*keep, F.coalesce("hits", none).alias("hits"))


class _Held:
    """The index of the block at hand, built once per worker."""

    def __init__(self):
        self.key, self.index = None, None

    def get(self, shared) -> Index:
        key, similarity, items, n, counts = shared.value
        if self.key != key:
            self.key, self.index = key, Index(items, similarity, n, counts)
        return self.index


_INDEX = _Held()


def report(found: DataFrame) -> DataFrame:
    """One row per document: whether it holds an item, which, and how alike."""
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0)).alias(
            "similarity"
        ),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    plain = Plain(docs)
    found = find(plain.frame, benchmark, plain.names, plain.name(text))
    return plain.back(found.where(F.size("hits") == 0))
