"""Corpus pipeline: each stage takes ``(spark, docs, sf_dir)``, is written as Parquet and read as the next one's docs.

Every stage but the last returns the columns of ``documents``; the last one returns token ids and digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bpe, mixing, near_dup, pii, quality
from quillspan.sources.shared import materialise, ship, shrink_driver, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents that the quality classifier does not reject."""
    ship(spark)
    shrink_driver(spark)  # this stage and the last one write no table of their own
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each near-duplicate group."""
    ship(spark)
    return near_dup.keep_first(spark, docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts without personal data and without terms that disclose it."""
    return pii.sanitise(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: a sample whose sources, languages and topics approach their target weights."""
    return mixing.sample(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every document that is left."""
    ship(spark)
    shrink_driver(spark)
    return bpe.encode_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_dup", keep_distinct),
    ("pii", sanitise),
    ("mixing", mix),
    ("bpe", encode),
]

#: Two stages are learned or sketched, which SQL cannot express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, f"stage-{name}")
    return docs
