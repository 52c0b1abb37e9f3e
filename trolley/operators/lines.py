"""Totals over order lines, aggregated as early as possible.

Counts and sums add up, so lines are reduced to totals before they are joined to anything.
The reduction happens in the map tasks, which is also what disarms a hot order or product:
its lines leave each task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.functions.sizing import BROADCAST_BYTES, fits_broadcast
from trolley.sources.readers import Tables


def basket_sizes(lines: DataFrame) -> DataFrame:
    """Lines per order."""
    return lines.groupBy("order_id").agg(F.count("*").alias("basket_size"))


def line_totals(lines: DataFrame, *keys: str) -> DataFrame:
    """Per key: lines, lines flagged as reordered, and lines whose flag is known."""
    return lines.groupBy(*keys).agg(
        F.count("*").alias("line_items"),
        F.sum("reordered").alias("reorders"),
        F.count("reordered").alias("flagged"),
    )


def merge_totals(totals: DataFrame, *keys: str) -> DataFrame:
    """Add up :func:`line_totals` over coarser keys."""
    return totals.groupBy(*keys).agg(
        F.sum("line_items").alias("line_items"),
        F.sum("reorders").alias("reorders"),
        F.sum("flagged").alias("flagged"),
    )


def reorder_rate() -> Column:
    """AVG(reordered) out of totals; NULL where no flag is known."""
    return F.try_divide(F.col("reorders"), F.col("flagged"))


def totals_by_product_attribute(
    t: Tables,
    lines: DataFrame,
    attribute: str,
    *keys: str,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """:func:`line_totals` by a column of the product table and further line columns.

    A small product table is broadcast, and the lines are never shuffled. A large one is
    joined to per-product totals instead: one row per product and ``keys``, so a product with
    a third of all lines does not weigh more than any other.
    """
    products = t["products"].select("product_id", attribute)
    if fits_broadcast(products, max_bytes):
        return line_totals(lines.join(F.broadcast(products), "product_id"), attribute, *keys)
    per_product = line_totals(lines, "product_id", *keys)
    return merge_totals(per_product.join(products, "product_id"), attribute, *keys)
