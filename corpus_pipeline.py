"""A training corpus from ``documents``: five stages, each working on all that the one before it kept.

toxicity: documents that the compression-distance model rejects go. near_dedup: of each group of near duplicates one
document stays. substring_dedup: words in 35-word windows that occur again go. mix: sources get their target weights by
whole turns through their blocks. encode: byte-level BPE ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, mixing, neardup, substring, toxicity
from tidelog.sources.tables import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text. A document that loses all its words stays, empty."""
    return substring.strip(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it, once at least."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["doc_id", "source"])


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix_sources), ("encode", encode)]

#: zstandard, ProbMinHash and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
