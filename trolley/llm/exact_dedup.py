"""Exact deduplication with keyed streaming state.

Every row leaves a short entry in a log: digest of the text, id and a locator of its content. A
stream reads the log and keeps one state per digest in a RocksDB state store, without expiry:
how many rows have it, and which of them stays (the largest id) with its place in the log as
locator. A digest that more than one row has is a hit; the full bytes of its rows are compared
before they count as equal.

Defined results: a null text counts as empty, and empty texts are equal. Of rows that also
share the id, one stays. A null id is smaller than any other. Rows that share a digest but not
the text are told apart by their text. An empty table gives an empty result. Columns besides
``doc_id`` and ``text`` take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.functions import scratch_path
from trolley.llm.filters import maybe_in
from trolley.llm.stages import keep_rows, staged, unused

#: Without preallocation a store takes the disk that its state needs, not 4 MB at least.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOG = "digest string, doc_id long, content string"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_log(
    docs: DataFrame,
    path: str,
    digest: Callable[[Column], Column] = sha256,
    content: Column | None = None,
) -> None:
    """Append one entry for each row of ``docs`` to the log at ``path``.

    ``content`` says where the row's text lies, such as ``F.input_file_name()`` of a table.
    """
    docs.select(
        digest(_text(docs)).alias("digest"),
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.lit(None) if content is None else content).cast("string").alias("content"),
    ).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path).select("*", _locator())


def keep_state(
    spark: SparkSession, log: str, state: str, files_per_batch: int = 1000
) -> DataFrame:
    """Bring the state at ``state`` up to the log and return a copy of it.

    The stream goes on from where an earlier call with the same paths ended, so entries that
    were appended since are the only ones that it reads.
    """
    entries = (
        spark.readStream.schema(LOG)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(log)
        .select("digest", F.struct("doc_id", _locator()).alias("entry"))
    )
    kept = entries.groupBy("digest").agg(F.max("entry"), F.count("*"))
    with _settings(spark, STORE):
        stream = (
            kept.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
        values = spark.read.format("statestore").load(state)
        keep, count = (F.col("value")[name] for name in values.schema["value"].dataType.names)
        return staged(
            values.select(
                F.col("key")["digest"].alias("digest"),
                keep["doc_id"].alias("keep_id"),
                keep["at"].alias("keep_at"),
                count.alias("group_size"),
            ),
            "kept",
        )


def hit_texts(docs: DataFrame, state: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest and text of the rows of ``docs`` whose digest more than one row has.

    A filter of fixed size lets other rows out before anything is shuffled; the few that it
    lets through do no harm, for they are alone with their digest.
    """
    texts = docs.select(_text(docs).alias("text")).withColumn("digest", digest(F.col("text")))
    return maybe_in(texts, state.where("group_size > 1").select("digest"), "digest")


def exact_duplicates(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    content: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, keep_id, group_size and kept."""
    spark = docs.sparkSession
    log, state_path = scratch_path(spark, "log"), scratch_path(spark, "state")
    write_log(docs, log, digest, content)
    state = keep_state(spark, log, state_path)
    texts = hit_texts(docs, state, digest).groupBy("digest")
    collided = staged(
        texts.agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .where("low <> high")
        .select("digest"),
        "collided",
    )
    entries = read_log(spark, log)
    if not collided.isEmpty():
        return _told_apart(docs, collided, digest)
    return entries.join(state, "digest").select(
        "doc_id",
        "digest",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == F.col("keep_at"))).alias(
            "kept"
        ),
    )


def _told_apart(
    docs: DataFrame, collided: DataFrame, digest: Callable[[Column], Column]
) -> DataFrame:
    """The same result, where colliding digests are replaced by others until none collide.

    The new key is the digest with the text appended for the rows of ``collided`` alone, so
    equal keys mean equal texts.
    """
    spark = docs.sparkSession
    keyed = (
        docs.select("doc_id", _text(docs).alias("text"))
        .withColumn("digest", digest(F.col("text")))
        .join(collided.withColumn("collides", F.lit(True)), "digest", "left")
        .withColumn("own", F.when(F.col("collides"), F.concat("digest", F.lit(":"), "text")))
    )
    log, state_path = scratch_path(spark, "log"), scratch_path(spark, "state")
    write_log(
        keyed.select("doc_id", F.coalesce("own", "digest").alias("text")), log, lambda text: text
    )
    state = keep_state(spark, log, state_path)
    return read_log(spark, log).join(state, "digest").select(
        "doc_id",
        F.substring_index("digest", ":", 1).alias("digest"),
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == F.col("keep_at"))).alias(
            "kept"
        ),
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows that share id and text, one."""
    kept = exact_duplicates(docs).where("kept").withColumnRenamed("digest", "text_key")
    digest = unused(docs, "_digest")
    marked = docs.withColumn(digest, sha256(_text(docs)))
    return keep_rows(marked, kept).dropDuplicates(["doc_id", digest]).select(*docs.columns)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _locator() -> Column:
    return F.concat_ws(
        "#", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")
    ).alias("at")
