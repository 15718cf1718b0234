"""Language identification by prediction by partial matching.

For every language a tree of byte contexts of orders 0 to 3 is counted over its
sample. The code length of a byte follows escape method C with exclusion: the
longest context seen codes the byte, or escapes to the next shorter one, whose
counts then leave out the bytes already ruled out; below order 0 the remaining
bytes are equally likely. The statistics are frozen, so a text's code length in
a language is the sum over its bytes of a function of four bytes, and is exact:
over all 256 next bytes of any context the probabilities sum to one.

A language's sample is at most ``most`` whole documents (drawn by hash), which
bounds the trees. Scoring sorts the four-byte runs of a batch, looks each
different one up once per language, and adds lengths by document; no row moves
between tasks.

Defined results: null texts and texts without a letter are ``und`` with score
0, and so is every text if no language could be learned. ``score`` is the share
of the best language under code lengths per 64 bytes; ties go to the first
language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.llm.common import by_hash, per_text

ORDER = 3
SAMPLE = 1200
PAD = b"\n" * ORDER
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte runs ending at each byte of each text, and the text's number."""
    whole = np.frombuffer(b"".join(PAD + t for t in texts) or PAD, dtype=np.uint8).astype(np.uint32)
    gram = whole[3:] | whole[2:-1] << 8 | whole[1:-2] << 16 | whole[:-3] << 24
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + ORDER) - ORDER
    keep = np.ones(len(gram), dtype=bool)
    for e in ends[:-1].tolist():
        keep[e : e + ORDER] = False
    return gram[keep], np.repeat(np.arange(len(texts)), sizes)


class Tree:
    """Frozen counts of one language and the code lengths they give."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        """Counts of different four-byte runs; lower orders are their sums."""
        order = np.argsort(gram)
        gram, count = gram[order].astype(np.uint64), count[order].astype(np.int64)
        self.grams, self.counts, self.contexts, self.n, self.t = {}, {}, {}, {}, {}
        for k in range(ORDER, -1, -1):
            short = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            self.grams[k], place = np.unique(short, return_inverse=True)
            self.counts[k] = np.bincount(place, weights=count).astype(np.int64)
            self.contexts[k], place = np.unique(self.grams[k] >> np.uint64(8), return_inverse=True)
            self.n[k] = np.bincount(place, weights=self.counts[k]).astype(np.int64)
            self.t[k] = np.bincount(place).astype(np.int64)
        # What a context rules out of the next shorter one's counts.
        self.gone = {}
        for k in range(1, ORDER + 1):
            context = np.searchsorted(self.contexts[k], self.grams[k] >> np.uint64(8))
            shorter = np.searchsorted(self.grams[k - 1], self.grams[k] & np.uint64((1 << 8 * k) - 1))
            self.gone[k] = np.bincount(context, weights=self.counts[k - 1][shorter]).astype(np.int64)

    @staticmethod
    def find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        return at, table[at] == values

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run after its first three."""
        gram = gram.astype(np.uint64)
        bits = np.zeros(len(gram))
        open_ = np.ones(len(gram), dtype=bool)
        gone_n = np.zeros(len(gram), dtype=np.int64)
        gone_t = np.zeros(len(gram), dtype=np.int64)
        for k in range(ORDER, -1, -1):
            short = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            context, known = self.find(self.contexts[k], short >> np.uint64(8))
            symbol, seen = self.find(self.grams[k], short)
            left_t = self.t[k][context] - gone_t
            total = self.n[k][context] - gone_n + left_t
            here = open_ & known & (left_t > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = np.log2(total) - np.log2(self.counts[k][symbol])
                escape = np.log2(total) - np.log2(left_t)
            # With every byte seen there is nothing to escape to.
            escape = np.where(self.t[k][context] == 256, 0.0, escape)
            full = here & (self.t[k][context] == 256)
            hit = np.where(full, np.log2(np.maximum(total - left_t, 1)) - np.log2(self.counts[k][symbol]), hit)
            bits += np.where(here, np.where(seen, hit, escape), 0.0)
            open_ &= ~(known & seen)
            if k:
                gone_n = np.where(known, self.gone[k][context], gone_n)
                gone_t = np.where(known, self.t[k][context], gone_t)
        rest = 256 - self.t[0][0]
        return bits + np.where(open_, np.log2(max(rest, 1)), 0.0)


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) sums of the four-byte runs of (lang, text) rows."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t.encode() for a, t in zip(langs, texts, strict=True) if a == lang and t]
            gram, n = np.unique(runs(own)[0] if own else np.empty(0, np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "gram", "n"],
            )


def fit(docs: DataFrame, allowed: Column, most: int = SAMPLE) -> dict[str, Tree]:
    """A tree per language, from at most ``most`` allowed documents of each."""
    ids = docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.select("doc_id", "lang")
    many = ids.groupBy("lang").agg(F.count("*").alias("_n"))  # one row per language
    chance = (F.lit(2.0 * most) / F.col("_n")) * 2.0**64 - 2.0**63
    # Sent to the ids, as the trees are to the texts, so that of a large language
    # only the ids within the range are dealt by language.
    few = ids.join(F.broadcast(many), "lang").where(by_hash("doc_id").cast("double") <= chance)
    first = Window.partitionBy("lang").orderBy(by_hash("doc_id"), "doc_id")
    few = few.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    few = few.select("doc_id", "lang").distinct()
    # At most ``most`` ids per language.
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(few), ["doc_id", "lang"])
    rows = (
        texts.select("lang", F.col("text").cast("string"))
        .mapInArrow(counts, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    trees = {}
    for lang, own in rows.groupby("lang"):
        trees[lang] = Tree(own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy())
    return trees


def bits(texts: list[bytes], trees: list[Tree]) -> np.ndarray:
    """Exact code length of every text in every language, in bits."""
    gram, owner = runs(texts)
    out = np.zeros((len(texts), len(trees)))
    if not len(gram):
        return out
    keys = np.sort(gram.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
    gram, owner = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    times = np.diff(np.r_[first, len(gram)])
    for i, tree in enumerate(trees):
        each = np.repeat(tree.lengths(gram[first]), times)
        out[:, i] = np.bincount(owner, weights=each, minlength=len(texts))
    return out


def identify(docs: DataFrame, trees: dict[str, Tree], keep: list[str]) -> DataFrame:
    """Columns ``keep``, lang_pred, score and the bits per byte of the best language."""
    names = sorted(trees)
    shared = docs.sparkSession.sparkContext.broadcast([trees[n] for n in names])

    def work(texts: list[bytes]) -> list[pa.Array]:
        lang, share, rate = [], [], []
        all_bits = bits(texts, shared.value) if names else None
        for i, t in enumerate(texts):
            if not names or not LETTER.search(t.decode("utf-8", "surrogatepass")):
                lang.append(UNKNOWN)
                share.append(0.0)
                rate.append(None)
                continue
            row = all_bits[i]
            best = int(np.argmin(row))
            scaled = (row - row[best]) * np.log(2) / max(1.0, len(t) / 64)
            lang.append(names[best])
            share.append(float(1 / np.exp(-np.minimum(scaled, 700)).sum()))
            rate.append(float(row[best]) / len(t))
        return [pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(rate, pa.float64())]

    return per_text(docs, "text", work, "lang_pred string, score double, bits_per_byte double", keep)
