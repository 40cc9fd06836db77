"""Corpus pipeline: quality, language, near-duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept; all but the
last return the columns of ``documents``. Models are fitted on the whole ``documents`` and ``labels``
tables of ``sf_dir`` (bounded samples of their learnable rows), so a stage's verdict on a document does
not depend on what earlier stages removed.

The near-duplicate stage takes shingles of five words at a similarity of 0.8. Null texts have no
language and go in stage two; rows that repeat are copies and go in stage three; of a group's documents the one
with the smallest id stays. Texts are taken whole, whatever their length. Empty tables give empty stages: without
labels every document scores 0.5 and stays, without a labelled language all go, without a benchmark nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelens.llm import decontamination, language_id, near_dedup, packing, quality_classifier
from farelens.sources.staging import materialize
from farelens.llm.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = quality_classifier.training_rows(table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs.select(*COLUMNS), quality_classifier.fit(table(spark, sf_dir, "documents"), labels))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language."""
    model = language_id.fit(language_id.training_rows(table(spark, sf_dir, "documents")))
    return language_id.keep_identified(docs.select(*COLUMNS), model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without benchmark passages in their texts."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("language_id", keep_language),
    ("near_dedup", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: SQL has no trained classifier; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
