"""Corpus pipeline: from ``documents`` to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.  The driver writes what a stage returns as
Parquet and hands it to the next one; :func:`run` does the same in the folder that
the session names in ``spark.checkpoint.dir``.

The stages are an estimate (quality), approximate in no other place, and the last
one packs by search; SQL cannot state the rows, so that there is no ``ORACLE_SQL``
and the tests compare with a plain version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import jaccard, packing, quality, secrets, substrings
from basketlens.llm.frames import shared_folder

#: Words of a window that counts as a repeated passage.
PASSAGE_WORDS = 50


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return jaccard.one_of_each(docs, 5, 80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id has too are cut out."""
    cut = substrings.dedup(docs, PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds."""
    return secrets.scan(docs, redact=True).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table; what each returns is written and read again."""
    shared = shared_folder(spark)
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
