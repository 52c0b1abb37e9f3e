"""Frequent itemsets and association rules over baskets (Spark MLlib's FP-growth)."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.functions.sizing import BROADCAST_BYTES, broadcast_if_small
from trolley.sources.writers import write_parquet


def baskets(
    pairs: DataFrame, min_support: float, path: str, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One array of items per ``order_id``, without the items that are too rare.

    The list of frequent items is written to ``path`` first. A small list is then broadcast, by
    the size of its files, and with a large one adaptive execution can split the pairs of a hot
    item, which it could not if the other side were still an aggregate.

    ``pairs`` has each ``order_id`` and ``item`` once. No frequent set can hold a rare item, so
    dropping those changes no result. It bounds every basket: the n kept items are each in
    ``min_support`` of the baskets, so n is at most (mean basket size / ``min_support``),
    however large a single order is. Baskets left empty stay, since support counts them.
    """
    if not 0 < min_support <= 1:
        raise ValueError(f"min_support must be above 0 and at most 1, not {min_support}")
    n_baskets = pairs.agg(F.count_distinct("order_id")).scalar()
    write_parquet(
        pairs.groupBy("item")
        .agg(F.count("*").alias("_baskets"))
        .where(F.col("_baskets") >= F.ceil(F.lit(min_support) * n_baskets))
        .select("item", F.col("item").alias("_frequent")),
        path,
    )
    frequent = pairs.sparkSession.read.parquet(path)
    return (
        pairs.join(broadcast_if_small(frequent, max_bytes), "item", "left")
        .groupBy("order_id")
        .agg(F.collect_list("_frequent").alias("items"))
    )


def mine(
    items: DataFrame, min_support: float, path: str, min_confidence: float = 0.8
) -> FPGrowthModel:
    """Fit FP-growth on the baskets of ``items``, which has ``order_id`` and ``item``.

    The distinct pairs are written once to ``path``, a folder that all executors share; support
    and baskets are taken from that copy. The baskets are written beside it, since FP-growth
    passes over them several times, and again when its results are read.
    """
    spark = items.sparkSession
    write_parquet(items.distinct(), f"{path}/pairs")
    pairs = spark.read.parquet(f"{path}/pairs")
    write_parquet(baskets(pairs, min_support, f"{path}/items"), f"{path}/baskets")
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    return fp.fit(spark.read.parquet(f"{path}/baskets"))


def frequent_itemsets(model: FPGrowthModel) -> DataFrame:
    """The frequent itemsets of all sizes: sorted ``items`` and their basket count."""
    return model.freqItemsets.select(
        F.array_sort("items").alias("items"), F.col("freq").alias("baskets")
    )


def frequent_pairs(model: FPGrowthModel) -> DataFrame:
    """The frequent itemsets of two items, as ``item_a`` < ``item_b`` with their basket count."""
    pair = F.col("items")
    return frequent_itemsets(model).where(F.size(pair) == 2).select(
        pair[0].alias("item_a"), pair[1].alias("item_b"), "baskets"
    )


def rules(model: FPGrowthModel) -> DataFrame:
    """Association rules; item sets are sorted, rates rounded to nine places."""
    return model.associationRules.select(
        F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"),
        F.array_join(F.array_sort("consequent"), ",").alias("consequent"),
        F.round("confidence", 9).alias("confidence"),
        F.round("lift", 9).alias("lift"),
        F.round("support", 9).alias("support"),
    )
