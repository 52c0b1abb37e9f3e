"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.stages import staged


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for the long pairs ``a``, ``b``.

    Each round hangs every neighbour on the smallest one it can see, so the number of rounds
    grows with the logarithm of the longest path, and a node with very many neighbours is only
    ever met by sums over its edges and joins that can be split; for that the sums are written
    before they are joined. Each round is written too, which cuts the lineage.
    """
    stars = staged(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        large = staged(_large_star(stars), "stars")
        stars = staged(_small_star(large), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = staged(both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")), "least")
    return (
        both.join(least, F.col("a") == F.col("_a"))
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("_a", "_m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")), "least")
    return (
        down.join(least, F.col("a") == F.col("_a"))
        .select(F.explode(F.array(F.struct("a", "_m"), F.struct(F.col("b").alias("a"), "_m"))))
        .select(F.col("col.a").alias("a"), F.col("col._m").alias("b"))
        .where("a <> b")
        .distinct()
    )
