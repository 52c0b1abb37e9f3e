"""A corpus from the table ``documents``: judged, deduplicated, mixed and encoded.

Defined results: each stage treats nulls, empty and repeated rows as the operator it calls says.
Of exact copies the row with the largest id stays, of near copies the one with the smallest; a
null text counts as an empty one, and the mix has no place for documents without words. Columns
besides ``doc_id``, ``text`` and ``source`` pass through all stages but the last. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.functions import scratch_path
from trolley.llm import exact_dedup, mixing, near_dups, pieces, quality
from trolley.llm.queries import PIECES
from trolley.llm.stages import keep_rows, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), pages)
    return keep_rows(docs, judged.where("keep"))


def different_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_first_copies(docs)


def dissimilar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dups.keep_one_of_each_group(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def encoded_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, score and decoded text of each document."""
    vocabulary = pieces.read_vocabulary(PIECES, ranked=True)
    return pieces.encode_and_decode(docs, vocabulary)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("exact_dedup", different_texts),
    ("near_dedup", dissimilar_texts),
    ("mixing", mixed_sources),
    ("sentencepiece", encoded_texts),
]

#: The quality classifier is trained and the segmentation searched, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, where each stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
