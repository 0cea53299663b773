"""Corpus pipeline: quality rules, exact dedup, near-dedup, privacy, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet into the shared
folder and reads it back as the next stage's docs. All stages but the last keep the columns of `documents`.

Cases, in every stage: a null text counts as empty (and is dropped by the quality rules, which ask for ten words);
rows with a null id are judged by their text like any others, but near-dedup never links them; rows repeated as a
whole are copies of each other, of which exact dedup keeps one; other columns pass through all stages but the last,
whatever their names are (helper columns have names of their own, and columns are read by position in Python); an empty
table gives an empty table with the same columns, and no pieces in the end; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaique.llm.common import bound_batches, read_table
from mosaique.llm.exact_dedup import drop_copies
from mosaique.llm.near_dedup import drop_near_copies
from mosaique.llm.packing import pack_documents
from mosaique.llm.privacy import replace_in
from mosaique.llm.quality import keep_good
from mosaique.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the corpus policy keeps, by the mask of failed rules; too short, repetitive or garbled ones go."""
    bound_batches(spark)
    return keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal without white space: the longest, then the smallest id."""
    return drop_copies(docs, as_read=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles: the smallest id. Texts without words stay."""
    bound_batches(spark)
    return drop_near_copies(docs, k=5, percent=80, as_read=True)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets, and `n_chars` brought up to date. Null texts stay null."""
    bound_batches(spark)
    return replace_in(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; a text without tokens is one piece with the end id."""
    bound_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

#: Surrogates and tokenised sequences are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
