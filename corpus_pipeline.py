"""The corpus pipeline: language, toxicity, repeated lines, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that the next
one gets as its documents; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import language_id, line_dedup, near_dedup, packing, toxicity
from lexiloom.llm._common import checkpoint


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; below 0.3 the classes are about level."""
    return language_id.keep_identified(docs, language_id.fit_language_model(docs), min_score=0.3)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less likely toxic than not."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that five or more share, but for the keeper's."""
    kept = line_dedup.line_dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identified), ("toxicity", civil), ("line_dedup", fresh_lines), ("near_dedup", distinct_documents), ("packing", packed)]

#: Classifiers, signatures and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
