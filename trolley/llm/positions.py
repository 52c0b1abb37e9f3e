"""Running sums within keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 250
BUCKETS_PER_GROUP = 1000


def running_start(
    df: DataFrame,
    key: str,
    amount: str,
    row: str,
    seed: int,
    into: str = "start",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its key that come before it.

    The order within a key is that of a hash of ``row``, a column of unique longs, so it is
    shuffled and the same in every run. A key is cut into buckets of about
    ``rows_per_bucket`` rows by that hash: sums run within buckets, the buckets' totals within
    groups of buckets, and only the groups' totals along a key. A null key counts as a key.
    """
    of = F.col(key).eqNullSafe
    counts = df.groupBy(F.col(key).alias("_key")).agg(
        F.ceil(F.count("*") / rows_per_bucket).alias("_buckets")
    )
    hashed = F.xxhash64(F.lit(seed), F.col(row))
    rows = (
        df.join(counts, of(F.col("_key")))
        .withColumn("_hash", hashed)
        .withColumn("_bucket", F.pmod("_hash", "_buckets"))
        .drop("_key", "_buckets")
    )
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(
        F.sum(amount).alias("_total")
    )
    before = _before(totals)
    within = (
        Window.partitionBy(key, "_bucket")
        .orderBy("_hash", row)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .join(before, of(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
        .withColumn(into, (F.col("_before") + F.col("_within")).cast("long"))
        .drop("_key", "_of", "_before", "_within", "_hash", "_bucket")
    )


def _before(totals: DataFrame) -> DataFrame:
    """``_key``, ``_of`` and the sum of ``_total`` over the key's earlier buckets."""
    until = Window.unboundedPreceding, -1
    grouped = totals.withColumn("_group", F.floor(F.col("_of") / BUCKETS_PER_GROUP))
    groups = grouped.groupBy(F.col("_key").alias("_gk"), F.col("_group").alias("_g")).agg(
        F.sum("_total").alias("_all")
    )
    along = Window.partitionBy("_gk").orderBy("_g").rowsBetween(*until)
    within = Window.partitionBy("_key", "_group").orderBy("_of").rowsBetween(*until)
    return (
        grouped.withColumn("_inside", F.sum("_total").over(within))
        .join(
            groups.withColumn("_outside", F.sum("_all").over(along)),
            F.col("_key").eqNullSafe(F.col("_gk")) & (F.col("_group") == F.col("_g")),
        )
        .select(
            "_key",
            "_of",
            (F.coalesce("_inside", F.lit(0)) + F.coalesce("_outside", F.lit(0))).alias("_before"),
        )
    )
