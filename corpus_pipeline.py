"""From documents to a training mix: five of the text operators in a row.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``docs``:

1. ``toxicity``: documents the classifier rejects go;
2. ``near_dedup``: of each group of near-duplicates (five-word shingles, 0.8) the
   document of the smallest id stays;
3. ``decontaminate``: documents that hold a benchmark item go;
4. ``secrets``: secrets inside texts are replaced by ``[kind]``, no row goes;
5. ``mix``: a row per document and epoch in which the mix takes it.

Null texts pass every stage but the mix, which takes no document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candidate_funnel.llm import decontaminate, mixture, odd_sketch, secret_battery, toxicity
from candidate_funnel.llm.common import table
from candidate_funnel.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return odd_sketch.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_battery.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.materialise(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

# Learned models and hashed fingerprints are beyond SQL; tests compare stages
# with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written once and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
