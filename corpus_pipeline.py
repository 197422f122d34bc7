"""A training-data pipeline over `documents`; each stage's result is written as Parquet and read again.

Quality classifier, quality rules, near-duplicate removal, removal of repeated passages, packing.  All but the last
stage return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import outliers, packing, quality, simhash, substring
from folioscan.llm.common import checkpoint_dir, documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the rest are unchanged.

    Null and empty texts have the score of a chunk of padding; equal texts have equal scores, repeated rows stay repeated.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go.

    Null, empty and blank texts fail the base rules; equal texts of a group get equal verdicts; a null language or source
    is a value like any other.
    """
    return outliers.accepted(docs, COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike to 0.8 or more over five words the document with the smallest doc_id stays.

    Null, empty and blank texts are one group; of repeated rows one stays, and rows without doc_id all stay.
    """
    return simhash.one_of_similar(docs, COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that a document with a smaller doc_id has go; a document may become empty but stays.

    A null text becomes an empty one; a null doc_id counts as the largest; rows with equal ids don't cut each other.
    """
    cut = substring.removal(docs, keep=("lang", "source"), text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents by sequence; a null or empty text is the end token alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pack", pack),
]

#: The classifier, the robust estimates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what passes between them is kept in the folder of the checkpoints, which executors share."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
