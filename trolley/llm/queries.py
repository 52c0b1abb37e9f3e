"""The queries of this subpackage over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm import (
    alignment,
    clusters,
    exact_dedup,
    languages,
    line_dedup,
    lm,
    mixing,
    near_dups,
    nearest,
    passages,
    pieces,
    quality,
    sharding,
    shared_passages,
    url_filters,
)
from trolley.llm.clusters_sql import cluster_sql
from trolley.llm.line_dedup_sql import REMOVE_REPEATS_SQL
from trolley.llm.near_dups_sql import NEAR_DUPLICATES_SQL
from trolley.llm.shared_passages_sql import REMOVE_SHARED_SQL
from trolley.llm.stages import table
from trolley.llm.url_filters_sql import RULES, judge_urls_sql

#: A SentencePiece model whose scores are merge ranks; read by the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: A byte-level vocabulary; read by the driver.
BYTE_PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The same vocabulary with its merges; read by the driver.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, root: str, model: str = PIECES) -> DataFrame:
    """Ids of all documents, the score of each, and the text that they decode to."""
    vocabulary = pieces.read_vocabulary(model, ranked=True)
    both = pieces.encode_and_decode(table(spark, root, "documents"), vocabulary)
    return both.withColumn("n_ids", F.size("ids"))


def op2_url_filters(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts on all pages. A page's label is that of the document with its id."""
    labels = table(spark, root, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.greatest((F.col("quality") == 0), (F.col("toxic") == 1)).alias("bad"),
    )
    return url_filters.judge_urls(table(spark, root, "pages"), labels, RULES)


def op3_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest vectors to every hundredth."""
    vectors = table(spark, root, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    """Class, number of links and group of each document."""
    return near_dups.near_duplicates(table(spark, root, "documents"))


def op5_sharding(spark: SparkSession, root: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return sharding.shard_documents(table(spark, root, "documents")).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


def op6_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Which row stays of the rows that share a text."""
    return exact_dedup.exact_duplicates(
        table(spark, root, "documents"), content=F.input_file_name()
    ).withColumnRenamed("digest", "text_sha256")


def op7_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality of all documents. A document's url is that of the page with its id."""
    return quality.judge(
        table(spark, root, "documents"),
        table(spark, root, "labels"),
        table(spark, root, "pages").select(F.col("page_id").alias("doc_id"), "url"),
    ).drop("text_key")


def op8_mixing(spark: SparkSession, root: str) -> DataFrame:
    """Words of each document in a mix of the sources."""
    return mixing.words_taken(table(spark, root, "documents"))


def op9_lm_scoring(spark: SparkSession, root: str, vocabulary: str = BYTE_PIECES) -> DataFrame:
    """Log probability of all documents, by word counts and by the model."""
    return lm.score(table(spark, root, "documents"), lm.read_ranks(vocabulary))


def op10_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """All documents without passages of over 50 words that occurred before."""
    return _with_places(shared_passages.remove_shared(table(spark, root, "documents")))


def op10_repeated_lines(spark: SparkSession, root: str) -> DataFrame:
    """All documents without lines that occurred before, of any number of words."""
    return _with_places(line_dedup.remove_repeats(table(spark, root, "documents"), min_words=1))


def op10_passage_dedup(spark: SparkSession, root: str) -> DataFrame:
    """All documents without passages of 50 words and lines of any length that occurred before."""
    return _with_places(passages.remove_passages(table(spark, root, "documents"), min_words=1))


def op11_token_alignment(
    spark: SparkSession, root: str, a: str = BYTE_BPE, b: str = PIECES
) -> DataFrame:
    """Groups and links of the tokens of two vocabularies in all documents."""
    tokenizers = alignment.read_tokenizers(a, b)
    return alignment.aligned_documents(alignment.align(table(spark, root, "documents"), tokenizers))


def op12_centroids(spark: SparkSession, root: str) -> DataFrame:
    """All vectors in eight clusters after ten rounds."""
    return clusters.with_inertia(clusters.cluster(table(spark, root, "embeddings")))


def op13_language(spark: SparkSession, root: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = table(spark, root, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = languages.predict(docs, languages.fit(docs.where(~held_out)))
    return found.withColumn("held_out", held_out)


def _with_places(found: DataFrame) -> DataFrame:
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id",
        "text",
        F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(" ", spans).alias("removed_spans"),
    )


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_url_filters": op2_url_filters,
    "op3_nearest": op3_nearest,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_centroids": op12_centroids,
    "op13_language": op13_language,
}

#: Operators whose number has a query with SQL above.
FURTHER: dict[str, Query] = {
    "op10_repeated_lines": op10_repeated_lines,
    "op10_passage_dedup": op10_passage_dedup,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": judge_urls_sql(),
    "op4_near_duplicates": NEAR_DUPLICATES_SQL,
    "op6_exact_dedup": """
        SELECT doc_id, sha256(COALESCE(text, '')) AS text_sha256,
               MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS keep_id,
               COUNT(*) OVER (PARTITION BY COALESCE(text, '')) AS group_size,
               doc_id = MAX(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS kept
        FROM documents""",
    "op10_line_dedup": REMOVE_SHARED_SQL,
    "op10_repeated_lines": REMOVE_REPEATS_SQL,
    "op12_centroids": cluster_sql(),
}
