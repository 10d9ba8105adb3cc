"""A corpus pipeline of five of the library's training-data operators, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.cluster import materialize
from matchloom.llm.line_dedup import dedup_lines
from matchloom.llm.packing import pack
from matchloom.llm.quality import rate_quality
from matchloom.llm.queries import documents, vocabulary
from matchloom.llm.simhash import keep_one_each
from matchloom.llm.substring_dedup import dedup_substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: null, empty and short texts among them. Every row is judged alone, so copies stay or go together."""
    return rate_quality(docs, keep_columns=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a near copy earlier go from the texts, in order of doc_id (null last) and place; no row goes.

    A text that loses all its lines is empty, a null text stays null. Rows equal in doc_id and text are one document given twice.
    """
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id. Linked are texts within three bits, and those with a
    Jaccard similarity of 0.8 and more on five-word shingles, which three bits alone would mostly miss.

    Texts without words are one group. Rows equal in doc_id and text are one document; null doc_ids stay if a group has no other.
    """
    return keep_one_each(docs, radius=3, shingle=5, similar=True)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Units that stand earlier go from the texts, short ones where they repeat together with their neighbours; no row goes.

    The order is that of doc_id (null last), the text's hash, and place. Null texts stay null.
    """
    return dedup_substrings(docs, runs=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in as few sequences of 4096 tokens as best fit finds for all that is left; a null or empty text is its end token alone."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Compression ratios, MinHash and BPE ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
