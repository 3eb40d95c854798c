"""The training-text pipeline: each stage writes Parquet that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodgeframe.llm import language_id, packing, simhash, toxicity
from lodgeframe.llm.queries import word_tokenizer
from lodgeframe.session import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those whose best language is doubtful, go."""
    return language_id.keep_known(docs, language_id.train(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; ``labels`` teaches what toxic is."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest id: operator 1 with its contract's settings."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, word_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("simhash", near_duplicates),
    ("packing", packed),
]

#: The stages train models, so no SQL states their rows; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written in the shared folder and read again."""
    base = f"{shared_folder(spark).rstrip('/')}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{base}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
