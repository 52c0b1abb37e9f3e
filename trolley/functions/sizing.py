"""Decide from Catalyst's size estimate whether a join side may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 10 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df``; None where a session has no way to ask for it.

    For a file scan it is the file size scaled to the columns read. Filters and grouping do
    not lower it and joins multiply it, so it errs on the large side. A client that is apart
    from its driver (Spark Connect) has no handle on the plan.
    """
    handle = getattr(df, "_jdf", None)
    if handle is None:
        return None
    return int(str(handle.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is known to be small. What is not known gets no hint and is shuffled."""
    size = estimated_bytes(df)
    return size is not None and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small; otherwise unchanged, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df
