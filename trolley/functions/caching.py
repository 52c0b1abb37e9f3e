"""Keep a DataFrame's rows for several actions, then release them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


@contextmanager
def cached(
    df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
) -> Iterator[DataFrame]:
    """Persist ``df`` for the length of a ``with`` block.

    Run the actions inside the block: a lazy result used after it is computed without the cache.
    """
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
