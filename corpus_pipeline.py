"""The corpus pipeline: five operators one after the other, each stage written and read again.

Every stage takes the documents that its predecessor kept, and all but the last return the columns
of the documents they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ordercash.llm import (
    decontamination,
    jaccard_join,
    packing,
    quality_classifier,
    quality_rules,
)
from ordercash.llm.common import small_batches, written
from ordercash.llm.queries import default_tokenizer, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host fails too often, go."""
    return quality_rules.accepted(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts below the cut go. The labels are learnt on these documents."""
    small_batches(spark)
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    small_batches(spark)
    return jaccard_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents lose the spans that are a benchmark's, and go if nothing is left."""
    small_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    small_batches(spark)
    placed = packing.packed(written(packing.pieces(docs, default_tokenizer()), "pieces"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("jaccard_join", jaccard_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokens, signatures and fitted weights are beyond SQL; the stages' tests hold brute force to them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
