"""Corpus preparation: documents go through the stages in order, each on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalume.llm import exact, packing, quality, similar
from catalume.llm.storage import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, rejects go.

    Null and empty texts have the model's prior as their score; repeated rows and null ids are judged row by row; no
    documents: none; other columns stay as they are.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts stays: that of the largest doc_id, one row of it.

    Null and empty texts are one group; a null id stays only where its group has no other; no documents: none; other
    columns stay as they are.
    """
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more.

    Candidates come from SimHash's covering masks and from MinHash bands, whole shingle sets decide; the smallest
    doc_id stays (null ids last), one row of it. Texts without words are one group; no documents: none; other columns
    stay as they are.
    """
    return similar.drop_similar(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents that stayed, in sequences of at most 1024; a row per piece.

    Null and empty texts have one token; repeated rows are packed as often as they stand; no documents: no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pack", pack),
]

#: Not expressible in SQL (the learned classifier, tokenizer and packing); tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
