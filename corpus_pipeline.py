"""The corpus pipeline: five stages from raw documents to encoded training texts.

Defined results: null and empty texts are documents like others (the
classifiers score their bias, they have no near-duplicates and no benchmark
words, and encode to no pieces); very long texts are read whole; repeated rows
stay as they are, as rows with one id are one document; of near-duplicates that
tie the smallest id stays; empty tables give empty tables; further columns, of
any names, pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillion.llm import decontaminate, neardup, pieces, quality, toxicity
from quillion.session import cut, delete, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from this stage's input, doesn't reject."""
    return quality.good(docs, read(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learnt from this stage's input, doesn't reject."""
    return toxicity.harmless(docs, read(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, checked by decoding them: doc_id, n_pieces, digests and lossless."""
    return pieces.round_trip(docs, ["doc_id"])


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Trained classifiers and segmentations aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder, until the next one is written."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
