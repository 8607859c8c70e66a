"""The training-data pipeline: each stage works on all documents that the one before kept.

language ID -> line dedup -> SimHash near-dedup -> benchmark decontamination -> source mixing. The
first four stages return the columns of documents; the last adds what the mix takes of each document.
No SQL can express it (compression, alignment, fingerprints). Tests hold line dedup, near-dedup, overlaps
and targets against brute force over all pairs or placements, language ID against held-out labels, and
run() against its stages one by one.

Nulls and edges: documents with a null or empty text are rejected by the first stage, as no language is
known; a null doc_id comes last wherever the earliest document counts; repeated rows fare alike, but
only one of them is left after near-dedup; empty tables give empty results; columns of any other name
pass through all stages, except that the last replaces size, source_size, target and taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import decontaminate, langid, line_dedup, mixing, simhash_dedup
from lumisift.llm.shared import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.accept_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines aligned with an earlier document go; so does a document left without a word."""
    return line_dedup.keep_unaligned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns, their size, their source's size and target, and the words taken of them."""
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mix_to_weights),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.select(*[F.col(c) for c in out.columns])
