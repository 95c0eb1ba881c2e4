"""Corpus preparation: five stages, each a table of documents written and read again.

``run`` gives one row per drawn document: doc_id, n_tokens and token_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import minhash, mixing, quality, secrets, sentencepiece
from loomspan.llm._base import dropped, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a rule learned from ``labels`` go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.near_dedup(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are redacted."""
    return secrets.redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the sources' weights: of a source above its share some
    go, of one below it some come more than once."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("sentencepiece", encoding),
]

#: Learned rules and a vocabulary file can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, source = table(spark, sf_dir, "documents"), True
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if not source:
            dropped(spark, before)
        source = False
    return STAGES[-1][1](spark, docs, sf_dir)
