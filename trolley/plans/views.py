"""Temporary views for the SQL form of the reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from trolley.sources.readers import Tables

# The view under which each table is queried; prefixed, to leave a caller's views alone.
SHORT_NAMES = {
    "order_products_prior": "prior",
    "orders": "orders",
    "products": "products",
    "departments": "departments",
    "aisles": "aisles",
}
VIEW_NAMES = {table: f"trolley_{name}" for table, name in SHORT_NAMES.items()}


def register_views(t: Tables) -> None:
    """Register the given tables; later calls replace the views of earlier ones."""
    for table, view in VIEW_NAMES.items():
        if table in t:
            t[table].createOrReplaceTempView(view)


def own_name(name: str) -> str:
    """A view name that no other call has."""
    return f"trolley_{name}_{uuid.uuid4().hex}"


@contextmanager
def own_views(spark: SparkSession, frames: Mapping[str, DataFrame]) -> Iterator[dict[str, str]]:
    """Views of their own names over ``frames``, for the length of a ``with`` block.

    Gives the name of each. A result of ``spark.sql`` is resolved when it is made, so it may be
    used after the block, and any number of table sets can be in use at once.
    """
    names = {name: own_name(name) for name in frames}
    try:
        for name, view in names.items():
            frames[name].createTempView(view)
        yield names
    finally:
        for view in names.values():
            spark.sql(f"DROP VIEW IF EXISTS {view}")


@contextmanager
def file_view(spark: SparkSession, path: str) -> Iterator[str]:
    """The name of a view over Parquet files, made by DDL, for the length of a block."""
    name, quoted = own_name("files"), path.replace("'", "\\'")
    spark.sql(f"CREATE TEMP VIEW {name} USING parquet OPTIONS (path '{quoted}')")
    try:
        yield name
    finally:
        spark.sql(f"DROP VIEW IF EXISTS {name}")


@contextmanager
def cached_view(spark: SparkSession, query: DataFrame) -> Iterator[str]:
    """The name of a view over ``query`` whose rows stay cached for the length of a block.

    Run the actions inside the block: what is used after it is computed without the cache.
    """
    name = own_name("cached")
    query.createTempView(name)
    try:
        spark.sql(f"CACHE TABLE {name}")
        yield name
    finally:
        spark.sql(f"UNCACHE TABLE IF EXISTS {name}")
        spark.sql(f"DROP VIEW IF EXISTS {name}")
