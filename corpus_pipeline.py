"""Corpus preparation: the documents table through stages, each an operator of the llm subpackage.

toxicity drops the documents that the classifier rejects, near_duplicates keeps one document of
each class, secrets puts a mark in place of every secret, packing places the rest in sequences.
All stages but the last return the columns of documents; each is written and read again before
the next. Null, empty and repeated rows are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from historian_spark.llm import neardup, packing, secrets, toxicity
from historian_spark.llm.common import durable, ship, table
from historian_spark.llm.queries import END_ID, WORD_BPE, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on docs and the labels table, does not reject."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship(spark)
    return neardup.keep_one(docs)


def mark_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a mark in place of every secret."""
    return secrets.redact(docs, secrets.text_thresholds(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their ids, placed in sequences."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE), END_ID)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mark_secrets), ("packing", pack)]

#: Learned scores, signatures and a tokenizer are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
