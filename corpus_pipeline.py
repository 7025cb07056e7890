"""A corpus pipeline in five stages, each an operator of ``codeweigh.llm``.

``run`` applies the stages to ``documents``; every stage's result is written
as Parquet in the shared folder and read back, so each can be repeated alone
and executors may be lost.  All stages but the last return the columns of
their input; extra columns pass through.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweigh.llm import decontaminate, exact_dedup, language, near_dedup, pieces
from codeweigh.llm.common import documents, held_out, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language: null, empty and letterless texts, and foreign ones."""
    model = language.fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return language.keep_known(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (white space aside) the longest, then the smallest ``doc_id``."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the smallest ``doc_id``."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.keep_clean(docs, documents(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document left."""
    return pieces.encode(docs).selectExpr("doc_id", "cast(size(ids) as bigint) n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: A trained language classifier is no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
