"""Document fingerprints from prefix polynomial hashes.

``prefix`` holds, for every position of a text, the hash of all code points
before it: ``sum c[j] * B^j mod P``. Two entries give the hash of any span, so

* spans are equal (up to a hash collision) if their hashes, moved to the same
  power, agree: ``same_span``;
* the longest common extension of two positions is found by binary search over
  span equality: ``common_extension``.

A *fingerprint* is read off the same arrays: the hash of the whole text, its
length, and a bottom-k sketch (the k smallest) of the hashes of all its windows
of ``WINDOW`` code points. The share of equal entries among the k smallest of
two sketches estimates the likeness of the texts, the Jaccard similarity of
their sets of windows. A text shorter than a window is one window.

Defined results: null is the empty text; the empty text has an empty sketch,
and two empty texts have likeness 1, an empty and another one 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidate_funnel.llm.common import mix64

# A Mersenne prime, so that remainders need no division, and two bases.
P = (1 << 31) - 1
BASES = (1_000_003, 911_382_323)
WINDOW = 24
SKETCH = 64

# Bytes of text in a range of ids, and how many ranges there are at most.
RANGE_BYTES = 32 << 20
MOST_RANGES = 65_536

_M = np.uint64(P)
_S = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainder by P of values below 2^62."""
    x = (x & _M) + (x >> _S)
    x = (x & _M) + (x >> _S)
    return np.where(x >= _M, x - _M, x)


class Powers:
    """Powers of a base and of its inverse, grown as texts get longer."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, P - 2, P)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, m, P)))])
            self.down = np.concatenate(
                [self.down, _mod(self.down * np.uint64(pow(self.inverse, m, P)))]
            )


POWERS = tuple(Powers(b) for b in BASES)


def codes(text: str) -> np.ndarray:
    """Code points, plus one so that no character is without weight."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return raw.astype(np.uint64) + np.uint64(1)


def prefix(c: np.ndarray, which: int = 0, before: int = 0, at: int = 0) -> np.ndarray:
    """Hashes of all prefixes, one more than there are code points.

    ``before`` is the hash of ``at`` code points already seen, whose entry comes first.
    """
    powers = POWERS[which]
    powers.reach(at + len(c) + 1)
    terms = _mod(c * powers.up[at : at + len(c)])
    out = np.empty(len(c) + 1, dtype=np.uint64)
    out[0] = before
    # Sums of fewer than 2^32 terms below 2^31 stay below 2^63.
    np.cumsum(terms, out=out[1:])
    out[1:] = np.remainder(out[1:] + np.uint64(before), _M)
    return out


def span(h: np.ndarray, start: int, stop: int, which: int = 0) -> int:
    """Hash of a span, as if it began at position 0."""
    powers = POWERS[which]
    powers.reach(start + 1)
    return (int(h[stop]) - int(h[start])) * int(powers.down[start]) % P


def same_span(h: list, i: int, g: list, j: int, n: int) -> bool:
    """Whether n code points from i in one text equal those from j in another;
    ``h`` and ``g`` hold each text's prefix hashes by base."""
    return all(
        span(h[k], i, i + n, k) == span(g[k], j, j + n, k) for k in range(len(BASES))
    )


def common_extension(h: list, i: int, g: list, j: int) -> int:
    """Length of the longest common extension from i and j, by binary search."""
    low, high = 0, min(len(h[0]) - 1 - i, len(g[0]) - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        if same_span(h, i, g, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def windows(h: np.ndarray, which: int = 0) -> np.ndarray:
    """Scattered hashes of all windows of a text with prefix hashes ``h``."""
    n = len(h) - 1
    w = min(WINDOW, n)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    powers = POWERS[which]
    raw = _mod((h[w:] + _M - h[: n - w + 1]) * powers.down[: n - w + 1])
    # A short text's length is part of its only window.
    return mix64(raw * np.uint64(64) + np.uint64(w))


def smallest(values: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest distinct values, sorted, cut to 32 bits."""
    values = values >> np.uint64(32)
    if len(values) > 16 * k:
        # Most lie above a cut that still leaves several times k of them.
        few = values[values < np.uint64((1 << 32) // len(values) * 6 * k)]
        few = np.unique(few)
        if len(few) >= k:
            return few[:k].astype(np.uint32)
    return np.unique(values)[:k].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common entries among the k smallest of both sketches."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, a).__and__(np.isin(both, b)).sum()) / len(both)


class Printed:
    """A text with its prefix hashes, windows and fingerprint."""

    def __init__(self, c: np.ndarray, head: Printed | None = None, keep: int = 0):
        """``keep`` code points are those of ``head``, whose hashes are reused."""
        self.c = c
        if head is None:
            self.h = [prefix(c, k) for k in range(len(BASES))]
        else:
            self.h = [
                np.concatenate(
                    [head.h[k][:keep], prefix(c[keep:], k, int(head.h[k][keep]), keep)]
                )
                for k in range(len(BASES))
            ]
        self.sketch = smallest(windows(self.h[0]))

    def text(self) -> str:
        """Length, whole hash by both bases, sketch; in hexadecimal."""
        whole = "".join(f"{int(h[-1]):08x}" for h in self.h)
        return f"{len(self.c):x}-{whole}-{self.sketch.astype('>u4').tobytes().hex()}"


def parse(fingerprint: str) -> np.ndarray:
    """The sketch of a fingerprint's text form."""
    raw = bytes.fromhex(fingerprint.rsplit("-", 1)[1])
    return np.frombuffer(raw, dtype=">u4").astype(np.uint32)


def numbers(values: list[int | None]) -> Column:
    """An array literal, however long, in one small expression."""
    texts = ",".join("" if v is None else str(v) for v in values)
    return F.transform(F.split(F.lit(texts), ","), lambda x: F.when(x != "", x).cast("bigint"))


def n_below(bounds: Column, n: int, value: Column, inclusive: bool) -> Column:
    """How many of ``n`` ascending bounds lie below a value, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(n, 1).bit_length()))])

    def step(found: Column, width: Column) -> Column:
        bound = F.get(bounds, found + width - 1)
        below = bound <= value if inclusive else bound < value
        return F.when((found + width <= n) & below, found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def in_order(docs: DataFrame, id_column: str, text: str, n: int | None = None) -> DataFrame:
    """(_bucket, _id, _text, _guest): rows dealt by id, then hash of the text, into ranges.

    ``n`` ranges, or one for ``RANGE_BYTES`` of text. An id (or null) of more
    rows than a range takes several. The first row of a range is also sent, as a
    guest, to the end of the range before it (that of the first range to the
    last), so that a task finds every row's successor among its own rows. Only
    ids and sizes are read to find the ranges; the driver holds two numbers per
    range, of which there are ``MOST_RANGES`` at most: beyond, ranges grow, and
    tasks still stream them.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_hash", F.xxhash64("_text"))
    total, nulls, size = rows.agg(
        F.count("*"), F.count(F.when(F.col("_id").isNull(), 1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))
    ).first()
    n = n or min(MOST_RANGES, max(int(size) // RANGE_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism))
    ids = rows.select("_id").where("_id is not null")
    share = [i / n for i in range(1, n)]
    # An id of many rows is several of the bounds.
    cuts = sorted(int(c) for c in ids.stat.approxQuantile("_id", share, 0.2 / n)) if n > 1 else []
    bounds = numbers(cuts)
    place = F.col("_hash") / F.lit(2.0**64) + 0.5

    def among(first: Column, last: Column) -> Column:
        """The range of a row's hash among those of its id."""
        return F.least(first + F.floor(place * (last - first + 1)), last)

    by_id = among(n_below(bounds, len(cuts), F.col("_id"), False), n_below(bounds, len(cuts), F.col("_id"), True))
    of_null = max(1, -(-nulls * n // max(total, 1)))
    by_null = among(F.lit(len(cuts) + 1), F.lit(len(cuts) + of_null))
    placed = rows.withColumn("_bucket", F.when(F.col("_id").isNull(), by_null).otherwise(by_id if cuts else F.lit(0)).cast("int"))
    # One row per range.
    firsts = {
        r["_bucket"]: r["_first"]
        for r in placed.groupBy("_bucket").agg(F.min(F.struct("_id", "_hash")).alias("_first")).collect()
    }
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    every = range(order[-1] + 1 if order else 0)
    at = F.col("_bucket")
    leads = F.col("_id").eqNullSafe(F.get(numbers([firsts[b]["_id"] if b in firsts else None for b in every]), at)) & (
        F.col("_hash") == F.get(numbers([firsts[b]["_hash"] if b in firsts else None for b in every]), at)
    )
    home = F.struct(at.alias("b"), F.lit(0).alias("guest"))
    away = F.struct(F.get(numbers([before.get(b) for b in every]), at).cast("int").alias("b"), F.lit(1).alias("guest"))
    sent = placed.withColumn("_to", F.explode(F.when(leads, F.array(home, away)).otherwise(F.array(home))))
    return (
        sent.select(F.col("_to.b").alias("_bucket"), "_id", "_text", F.col("_to.guest").alias("_guest"), "_hash")
        .repartition(max(len(order), 1), "_bucket")
        .sortWithinPartitions("_bucket", "_guest", F.asc_nulls_last("_id"), "_hash", "_text")
        .drop("_hash")
    )


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, "
    "same_as_edited bigint, same_as_next bigint"
)


def edited(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document's text.

    The last ``n_chars // 2`` code points are replaced by the first as many (or
    all) of the next document by ascending id (the last is followed by the
    first; null ids come last, rows of one id go by a hash of their text). ``same_as_edited``
    and ``same_as_next`` are the longest common extensions from position 0.
    """
    names = T.StructType.fromDDL(RESULT).names

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                yield [c[i].as_py() for c in columns]

    def one(doc_id, t, now: Printed, following: Printed) -> list:
        size = len(now.c)
        half = size // 2
        keep = size - half
        c = np.concatenate([now.c[:keep], following.c[:half]])
        new = Printed(c, now, keep)
        raw = (c - np.uint64(1)).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        return [
            doc_id, size, hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest(),
            now.text(), new.text(), likeness(now.sketch, new.sketch),
            likeness(now.sketch, following.sketch),
            common_extension(now.h, 0, new.h, 0), common_extension(now.h, 0, following.h, 0),
        ]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [pa.field(n_, t) for n_, t in zip(names, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 2], strict=True)]
        )
        out, last, guest_of = [], None, None
        for bucket, doc_id, t, guest in rows(batches):
            if guest and guest_of == bucket:
                continue  # another row of the same first id
            here = Printed(codes(t or ""))
            if last is not None and last[0] == bucket:
                out.append(one(last[1], last[2], last[3], here))
            last = None if guest else (bucket, doc_id, t, here)
            guest_of = bucket if guest else None
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return in_order(docs, id_column, text, n).mapInArrow(work, RESULT)
