"""Quality rules whose thresholds come from quantile sketches per language and source.

A text is measured once: words, symbols, repeated lines and repeated stretches,
each as whole thousandths of its words or lines. The measures of all texts that
pass the base rules feed one sketch per language, source and measure: counts of
buckets as wide as 1/32 of their value (values below 64 are exact). Sketches
merge by adding counts, in any order and with the same result, so they are plain
aggregates, combined before the shuffle; a language's sketch is the merger of its
sources' sketches, and that of all texts the merger of the languages'.

Thresholds are outer fences: ``FENCE`` times the distance of the quartiles (a
measure's ``least`` distance where they lie closer) beyond the upper quartile,
and for measures with two sides also below the lower one. A source of fewer than
``ENOUGH`` texts in a language takes the thresholds of the language, a language
with fewer those of all texts. The thresholds are joined back to the measures.

Defined results: null texts have no words; texts of fewer than ``LEAST_WORDS``
words, and those of which more than ``MOST_REPEATED`` percent are in repeated
stretches, fail the base rules. A null language or source is a language or
source. Repeated rows each count. Lines without a word repeat nothing. An empty
table has no thresholds and no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidate_funnel.llm.common import Plain, per_text
from candidate_funnel.operators.skew import hot_join, slots
from candidate_funnel.session import cut

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

# Measure: (count, out of, two sides, least distance of the quartiles), in thousandths.
MEASURES = {
    "word_length": ("word_chars", "n_words", True, 400),
    "symbols": ("n_symbols", "n_words", False, 10),
    "dup_lines": ("n_dup_lines", "n_lines", False, 200),
    "repeats": ("n_repeat_words", "n_words", False, 50),
}
FENCE = 3
ENOUGH = 100
EXACT_BITS = 6

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"

# Tables of thresholds up to this many rows (about 200 bytes each) are broadcast.
BROADCAST_ROWS = 50_000


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside stretches of ``WINDOW`` words that occur twice or more."""
    stretches = list(zip(*[words[k:] for k in range(WINDOW)], strict=False))
    if len(set(stretches)) == len(stretches):
        return 0
    times = Counter(stretches)
    again = np.array([times[s] > 1 for s in stretches])
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` of one text."""
    words = text.split()
    joined = np.frombuffer(b"".join(words), dtype=np.uint8)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        # All bytes but those that continue a code point.
        int(((joined & 0xC0) != 0x80).sum()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, the ``COUNTS`` of each text and ``base_failed``."""

    def work(texts: list[bytes]) -> list[pa.Array]:
        rows = np.array([counts(t) for t in texts], dtype=np.int64).reshape(len(texts), -1)
        return [pa.array(column) for column in rows.T]

    short = F.col("n_words") < LEAST_WORDS
    repeated = F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    return per_text(docs, text, work, COUNTS, keep).withColumn("base_failed", short | repeated)


def value(name: str) -> Column:
    """A measure of a row of counts in whole thousandths."""
    count, out_of, _, _ = MEASURES[name]
    return F.call_function("div", F.col(count) * 1000, F.greatest(F.col(out_of), F.lit(1)))


def bucket(whole: Column) -> Column:
    """Lower end of the bucket of a whole number."""
    shift = F.greatest(F.length(F.bin(whole)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", whole, shift), shift)


def sketch(measured: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, measure, bucket, n) over the rows that pass the base rules."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(value(m)).alias("bucket")) for m in MEASURES])
    passed = measured.where(~F.col("base_failed")).select(*by, F.explode(entries).alias("_e"))
    return passed.groupBy(*by, "_e.measure", "_e.bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of fewer, larger groups."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, fences): low and high end of every measure, by name.

    A group's sketch has at most some thousand buckets, however large the group.
    """
    group = [*by, "measure"]
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bucket")
    placed = sketches.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(whole))

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * k, F.col("bucket")))

    found = placed.groupBy(*group).agg(F.max("_all").alias("n"), quartile(1).alias("_q1"), quartile(3).alias("_q3"))
    least = F.lit(None).cast("bigint")
    two_sided = F.lit(False)
    for name, (_, _, both, distance) in MEASURES.items():
        least = F.when(F.col("measure") == name, F.lit(distance)).otherwise(least)
        two_sided = F.when(F.col("measure") == name, F.lit(both)).otherwise(two_sided)
    distance = F.greatest(F.col("_q3") - F.col("_q1"), least) * FENCE
    ends = F.struct(
        F.when(two_sided, F.col("_q1") - distance).otherwise(F.lit(0)).cast("bigint").alias("low"),
        (F.col("_q3") + distance).cast("bigint").alias("high"),
    )
    listed = F.map_from_entries(F.collect_list(F.struct("measure", ends.alias("ends"))))
    return found.groupBy(*by).agg(F.max("n").alias("n"), listed.alias("fences"))


def thresholds(measured: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, inner, n, fences) of every pair; ``n`` rows gave the pair's own sketch.

    Small pairs hold the fences of their ``outer`` group or of all rows.
    """
    own = cut(sketch(measured, [outer, inner]))
    middle = merge(own, [outer])
    pairs, groups = fences(own, [outer, inner]), fences(middle, [outer])
    # One row: the fences of all texts.
    whole = fences(merge(middle, []), []).first()
    ends = whole["fences"] if whole else {}
    of_all = F.create_map(
        *[
            part
            for name in MEASURES
            for part in (F.lit(name), F.struct(*[F.lit(ends[name][e] if ends else None).cast("bigint").alias(e) for e in ("low", "high")]))
        ]
    )
    wider = groups.select(outer, F.when(F.col("n") >= ENOUGH, F.col("fences")).otherwise(of_all).alias("_wider"))
    return pairs.join(wider, outer).select(
        outer, inner, "n", F.when(F.col("n") >= ENOUGH, F.col("fences")).otherwise(F.col("_wider")).alias("fences")
    )


def verdict() -> Column:
    """Whether all measures of a row lie inside its ``fences``."""
    inside = F.lit(True)
    for name in MEASURES:
        ends = F.element_at("fences", name)
        inside = inside & value(name).between(ends["low"], ends["high"])
    return inside


def judge(measured: DataFrame, limits: DataFrame, on: Sequence[str]) -> DataFrame:
    """``measured`` with ``kept``. Rows that fail the base rules need no thresholds."""
    limits = cut(limits)
    right = limits.select(*on, "fences")
    if limits.count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(right), list(on), "left")
    else:
        joined = hot_join(measured, right, on, "left", slots(limits.withColumnRenamed("n", "_n"), on))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict(), F.lit(False))).drop("fences")


def named(column: str) -> Column:
    """A column as text that is never null, and null unlike any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def judged(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Columns ``keep``, the ``COUNTS``, ``base_failed`` and ``kept`` of every row."""
    plain = Plain(docs)
    held = [plain.name(c) for c in keep]
    rows = plain.frame.withColumn("_outer", named(plain.name(lang))).withColumn("_inner", named(plain.name(source)))
    measured = cut(measure(rows, plain.name(text), [*held, "_outer", "_inner"]))
    done = judge(measured, thresholds(measured, "_outer", "_inner"), ["_outer", "_inner"])
    return done.drop("_outer", "_inner").withColumnsRenamed(dict(zip(held, keep, strict=True)))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    plain = Plain(docs)
    rows = plain.frame.withColumn("_outer", named(plain.name(lang))).withColumn("_inner", named(plain.name(source)))
    measured = measure(rows, plain.name(text), ["_outer", "_inner"])
    limits = thresholds(cut(measured), "_outer", "_inner")
    # Texts are measured again rather than written with their measures.
    again = measure(rows.withColumn("_whole", F.col(plain.name(text))), "_whole", [*plain.names, "_outer", "_inner"])
    return plain.back(judge(again, limits, ["_outer", "_inner"]).where("kept"))
