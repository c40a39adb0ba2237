"""Pipeline over ``documents``: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphloom import ship
from glyphloom.llm import bktree, langid, packing, pii, quality
from glyphloom.sources.scratch import scratch_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told."""
    ship(spark)
    return langid.filter_language(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the fixed rules and the fences of their language and source."""
    ship(spark)
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates."""
    ship(spark)
    return bktree.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    ship(spark)
    return pii.redact_documents(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts and parts of texts, each with its bin and its place in it."""
    ship(spark)
    return packing.pack(docs, with_text=True)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit),
]

#: SQL can express neither the model of the first stage nor the third one's hash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    folder = scratch_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{i}")
        docs = spark.read.parquet(f"{folder}/stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
