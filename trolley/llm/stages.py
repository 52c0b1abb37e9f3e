"""Cut lineage by written tables, and count what decides how far to spread work."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.functions import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Later steps then start from files that every executor sees, so a lost executor costs the
    tasks that it ran and no more.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    """So many buckets that each gets about ``rows_per_bucket`` rows, whatever their number."""
    return max(1, math.ceil(rows / rows_per_bucket))


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df``."""
    taken = {column.lower() for column in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and digest of the text are in ``kept``.

    ``kept`` has doc_id and text_key, the SHA-256 of the text, where null counts as empty.
    """
    kept_id, kept_key = unused(docs, "_id"), unused(docs, "_key")
    wanted = kept.select(
        kept["doc_id"].alias(kept_id), kept["text_key"].alias(kept_key)
    ).distinct()
    return docs.join(
        wanted,
        docs["doc_id"].cast("long").eqNullSafe(wanted[kept_id])
        & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == wanted[kept_key]),
        "left_semi",
    )
