"""A training corpus from raw documents: five stages, each over all that the stage before it kept.

Stages in between return the columns of their input, whatever these are called; the last returns token ids per document. Every
stage's output is written to the shared folder and read again, so a lost executor repeats one stage's tasks only.

Edge cases: null and empty texts fail the quality rules, so nothing later meets them; null labels teach nothing. Equal rows are one
document to the near-duplicate stage, which keeps the least id of a class and all rows of that id; rows without an id stay. An
empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldgauge.llm import decontamination, language_id, near_dedup, pieces, quality
from fieldgauge.llm.tables import workspace, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the languages, and how well unseen texts fit them, are learned from the labels of
    all given documents. Where none has a label and a text, all stay."""
    return language_id.keep_known(docs, language_id.learned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, checked by decoding them."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("token_ids", token_ids),
]

# Signatures, context trees and piece ids are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = workspace(docs, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
