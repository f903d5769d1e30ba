"""The corpus pipeline: documents in, encoded documents out, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``, and any others that
the table has, whatever their names. Every stage takes null ids, nulls in any column, texts of any
length, repeated rows and empty tables; what becomes of them is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barweave.llm import bpe, decontaminate, langid, nearcopies, pii
from barweave.llm.common import held_out, read, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``und`` and doubtful ones go. Learned from the rows that are not held out.

    Null and empty texts have no language and go; repeated rows share their fate; long texts are read whole.
    Without any labelled row nothing can be recognised, and no document stays.
    """
    return langid.accepted(docs, langid.train(docs.where(~held_out())))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: five-word shingles, Jaccard similarity 0.8.

    Operator 3 with a similarity in place of its two bits. Of rows that repeat an id and a text one stays; a
    null id stays only in a group without any other; null and empty texts are one group.
    """
    return nearcopies.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs. Null and empty texts stay, and so do repeated rows, each by itself."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind. Null and empty texts stay as they are; so do repeated rows."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids: ``doc_id, n_tokens, ids``. Null and empty texts have none; repeated rows have theirs each."""
    return bpe.encode(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL can express none of the five stages; tests/llm/test_pipeline.py holds it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
