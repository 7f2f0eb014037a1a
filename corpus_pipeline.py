"""The training-corpus pipeline: five operators, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Cases, for every stage: a null text counts as an empty one, and may come back as one; empty texts are judged like others (the
classifier by statistics of zero; all empty texts are copies of each other, so the one of least id stays); null ids are
allowed and are the least; rows that repeat both id and text are one document, so near-dedup keeps one of them; rows that share an id but not a text are
documents of their own; of texts that tie, the one of least id stays; an empty table gives an empty one; further columns, whatever their names, go along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, decontaminate, neardup, quality, substrings
from lectern.llm.common import configured, fold, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id stays."""
    return neardup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go."""
    return substrings.cleaned(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by ten consecutive words of a benchmark item go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _configured(stage):
    return lambda spark, docs, sf_dir: stage(configured(spark), docs, sf_dir)


STAGES = [(f.__name__, _configured(f)) for f in (quality_rules, near_duplicates, repeated_passages, benchmark_passages, byte_bpe)]

#: The classifier and the sampling can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
