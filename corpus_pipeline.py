"""A training-text pipeline over the documents table: each stage works on all that the one before kept."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factweave.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from factweave.llm.storage import materialize, release, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly; the dictionaries are fitted on these documents' labels."""
    return language_id.accepted(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat; one of whose text nothing visible is left goes."""
    found = line_dedup.dedup_lines(docs, every=True)
    return found.where(r"not (__lost > 0 and text rlike '^\\s*$')").select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with the hashes of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _anew(stage):
    """The stage, with the memory that executors hold for what went before given back as it begins, and again before its
    result is written, as most of its tables are made by then and Python works on the texts."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        out = stage(spark, docs, sf_dir)
        release(spark)
        return out

    return run


STAGES = [
    (name, _anew(stage))
    for name, stage in (
        ("language id", language),
        ("line dedup", lines),
        ("near dedup", copies),
        ("decontamination", leaks),
        ("byte-level bpe", tokens),
    )
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The compressor, the similarity joins and the merges are beyond SQL; brute-force tests stand in.
ORACLE_SQL = None
