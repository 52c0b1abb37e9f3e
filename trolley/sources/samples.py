"""The test tables (``orders``, ``lineitem``, ``part``) seen as order tables.

Everything is a projection of the given Parquet except two columns of ``orders``:
``order_number`` and ``days_since_prior_order`` need the customer's order sequence. They are
added on request only, so that reports that do not use them do not pay for a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.windows import HOT_ROWS, hot_keys, mark_hot, running_totals
from trolley.sources.readers import Tables

# Fixed value: a Saturday before the first order, so that day-of-week 0 is Saturday.
WEEK_START = "1994-12-31"


def _orders(spark: SparkSession, root: str) -> DataFrame:
    ordered_on = F.to_date("o_orderdate")
    return spark.read.parquet(f"{root}/orders.parquet").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("eval_set"),
        (F.datediff(ordered_on, F.lit(WEEK_START).cast("date")) % 7).alias("order_dow"),
        (F.col("o_orderkey") % 24).cast("int").alias("order_hour_of_day"),
        F.col("o_orderdate").alias("order_ts"),
    )


def number_orders(
    orders: DataFrame, hot_rows: int = HOT_ROWS, ids_per_block: int = HOT_ROWS
) -> DataFrame:
    """Add ``order_number`` and ``days_since_prior_order`` from each user's order sequence.

    Users with more than ``hot_rows`` orders are cut by day, then by time and range of order
    ids. The number is a bigint: a third of the orders of a very large shop exceeds an int.
    """
    day = F.to_date("order_ts")
    sequenced = running_totals(
        mark_hot(orders, "user_id", hot_keys(orders, "user_id", hot_rows)),
        key="user_id",
        order_by=["order_ts", "order_id"],
        totals={"order_number": F.lit(1)},
        previous={"prior_day": day},
        blocks=[day, F.struct("order_ts", F.floor(F.col("order_id") / ids_per_block))],
        max_rows=hot_rows,
    )
    return sequenced.select(
        "order_id",
        "user_id",
        "eval_set",
        "order_number",
        "order_dow",
        "order_hour_of_day",
        F.datediff(day, "prior_day").cast("double").alias("days_since_prior_order"),
        "order_ts",
    )


def _lines(spark: SparkSession, root: str) -> DataFrame:
    # Null-safe comparison: it is never NULL, so a filter on the flag reaches the Parquet scan.
    returned = F.col("l_returnflag").eqNullSafe("R")
    return spark.read.parquet(f"{root}/lineitem.parquet").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("add_to_cart_order"),
        F.when(returned, 1).otherwise(0).alias("reordered"),
    )


def _department_names(parts: DataFrame) -> Column:
    """The sorted part types, one short list of category names, as a scalar subquery."""
    return parts.agg(F.array_sort(F.collect_set("p_type"))).scalar()


def sample_tables(
    spark: SparkSession, root: str, numbered: bool = False, hot_rows: int = HOT_ROWS
) -> Tables:
    """Order tables over the test Parquet in ``root``; ``numbered`` adds the order sequence."""
    parts = spark.read.parquet(f"{root}/part.parquet")
    names = _department_names(parts)
    aisle_id = F.substring("p_brand", 7, 10).cast("int")
    orders = _orders(spark, root)
    return {
        "aisles": parts.select(
            aisle_id.alias("aisle_id"), F.col("p_brand").alias("aisle")
        ).distinct(),
        # A product's department is its type's place in the sorted list: a projection, where
        # joining a department table here would hide the product table's size from Catalyst.
        "departments": parts.select(
            F.array_position(names, F.col("p_type")).cast("int").alias("department_id"),
            F.col("p_type").alias("department"),
        ).distinct(),
        "products": parts.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            aisle_id.alias("aisle_id"),
            F.array_position(names, F.col("p_type")).cast("int").alias("department_id"),
        ),
        "orders": number_orders(orders, hot_rows) if numbered else orders,
        "order_products_prior": _lines(spark, root),
    }
