"""A training corpus out of documents: classified, near-deduplicated, rid of repeated passages, mixed, and encoded.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns with any names,
as its operator's module states, and all but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import shared
from tidemark.llm import bpe, mixing, neardup, quality, repeats
from tidemark.llm.common import settled, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's limit. Null and empty texts go; repeated rows stay or go together; a null
    language is judged by the model of all trusted text; without labels all documents with text stay."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (similarity 0.8 or more over five-word shingles): that of the least doc_id, null
    last, once. Texts without words are no duplicates, and all their rows stay."""
    return neardup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated 200-byte strings; documents that nothing is left of go. Null texts become empty; shorter texts stay whole;
    all rows of a text that repeats go if it has 200 bytes."""
    return repeats.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the last time in part. Null sources are a source; texts without words are never taken;
    equal rows are taken as one."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix: doc_id and ids, none for null and empty texts, for repeated rows each."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", classified),
    ("MinHash near-dedup", near_deduplicated),
    ("suffix-array dedup", without_repeats),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]

#: SQL can express neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        # what a stage stored on its way, and the stage before it, are deleted once it is written
        last, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            shared.clear(spark, since=[p for p in shared.paths() if p != last.stored_at])
    return docs
