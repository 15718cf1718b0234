"""What the text operators share: words, held-out rows, batches of whole texts.

A text is cut into words the same way everywhere: runs of characters that are
none of space, tab, line feed, vertical tab, form feed and carriage return.
``bytes.split()`` of the UTF-8 form cuts at exactly these, so tasks use that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"

# Texts handled at once inside a task are cut at this many bytes, or one text.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo; null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)).cast("int")


def held_out(column: str, modulus: int, rest: int) -> Column:
    return remainder(column, modulus) == rest


def lower_ascii(column: Column | str) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(column: Column | str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def per_text(
    df: DataFrame,
    text: str,
    work: Callable[[list[bytes]], Sequence[pa.Array]],
    fields: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns ``keep`` of ``df``, then those that ``work`` makes of the texts.

    ``work`` gets UTF-8 texts (null as empty) in batches of bounded size and
    returns one Arrow array per field of ``fields``. No row moves between tasks.
    """
    kept = df.select(*keep, F.col(text).cast("string").alias("_text"))
    made_fields = T.StructType.fromDDL(fields).fields
    schema = T.StructType([*kept.schema.fields[:-1], *made_fields])
    names, n_kept = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_kept)
            for start, stop in spans_of_bytes(texts, BATCH_BYTES):
                part = texts.slice(start, stop - start).cast(pa.large_binary())
                made = work([t or b"" for t in part.to_pylist()])
                arrays = [batch.column(i).slice(start, stop - start) for i in range(n_kept)]
                yield pa.RecordBatch.from_arrays([*arrays, *made], names=names)

    return kept.mapInArrow(run, schema)


def parts_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[bytes]]:
    """Texts of batches of one column in lists of at most ``most`` bytes or of one."""
    for batch in batches:
        texts = batch.column(0)
        for start, stop in spans_of_bytes(texts, most):
            part = texts.slice(start, stop - start).cast(pa.large_binary())
            yield [t or b"" for t in part.to_pylist()]


def spans_of_bytes(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of an array of texts, each of at most ``most`` bytes or of one row."""
    if len(texts) == 0:
        return []
    sizes = np.array(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    spans, start, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            spans.append((start, i))
            start, held = i, 0
        held += size
    spans.append((start, len(sizes)))
    return spans


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal numbers stay equal, others scatter."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Memo(dict):
    """A function of a word, kept for the words of a task up to a bound.

    The bound only limits memory: past it the table starts afresh, results
    stay the same.
    """

    def __init__(self, function: Callable, most: int = 400_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.function(word)
        return value


def by_hash(id_column: str) -> Column:
    """A reproducible random number of a row's id."""
    return F.xxhash64(F.col(id_column), F.lit(17))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(_text, label) of at most ``most`` labelled ids whose rows are ``allowed``.

    Ids are drawn by hash from the labels alone, so only their texts are read
    further. Of several labels of one id the largest holds; null ones do not.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    # Ids far beyond those needed are left out before they meet in one place.
    chance = min(1.0, 4.0 * most / max(known.count(), 1))
    ids = (
        known.where(by_hash(id_column).cast("double") <= chance * 2.0**64 - 2.0**63)
        .groupBy(id_column)
        .agg(F.max(label).cast("int").alias("label"))
        .where(allowed)
        .orderBy(by_hash(id_column), id_column)
        .limit(most)
    )
    return docs.select(id_column, F.col(text).cast("string").alias("_text")).join(
        F.broadcast(ids), id_column  # ``most`` rows
    )


def add_constant(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class Plain:
    """``docs`` under names of our own, so that what is added cannot clash.

    ``frame`` has the columns ``names``; ``back`` restores the originals, some of
    them replaced.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.types = [f.dataType for f in docs.schema.fields]
        self.names = [f"_k{i}" for i in range(len(self.columns))]
        self.frame = docs.toDF(*self.names)

    def name(self, column: str) -> str:
        return self.names[self.columns.index(column)]

    def back(self, frame: DataFrame, replaced: dict[str, Column] | None = None) -> DataFrame:
        replaced = replaced or {}
        return frame.select(
            *[
                replaced[c].cast(t).alias(c) if c in replaced else F.col(n).alias(c)
                for c, n, t in zip(self.columns, self.names, self.types, strict=True)
            ]
        )
