"""Small order tables with known contents, and comparison helpers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from trolley.sources.schemas import TABLE_COLUMNS

CLEAN_ORDERS = TABLE_COLUMNS["orders"] + ", order_ts TIMESTAMP_NTZ"


def rows(df, *columns):
    """Rows as sorted tuples, for comparison without regard to order."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lines_frame(spark, lines):
    return spark.createDataFrame(lines, TABLE_COLUMNS["order_products_prior"])


def orders_frame(spark, orders):
    return spark.createDataFrame(orders, CLEAN_ORDERS)


def make_tables(spark, users=30, seed=7):
    """A shop of 4 departments and 9 aisles where one order, product and user are hot.

    User 1 places a third of the orders. Order 1 and product 1 each hold about a third of the
    lines. One line names a product outside the product table, one product a department
    outside the department table, and some orders have no lines.
    """
    rng = random.Random(seed)
    products = [(p, f"product {p}", p % 9 + 1, p % 4 + 1) for p in range(1, 41)]
    products.append((99, "no department", 3, 77))
    orders, lines, order_id = [], [], 0
    for user in range(1, users + 1):
        day = datetime(2017, 1, 1)
        for number in range(1, (100 if user == 1 else rng.randint(2, 9)) + 1):
            order_id += 1
            gap = None if number == 1 else float(rng.randint(0, 30))
            day += timedelta(days=gap or 0.0)
            hour = rng.randint(0, 23)
            orders.append(
                (order_id, user, "prior", number, rng.randint(0, 6), hour, gap,
                 day + timedelta(hours=hour))
            )
            if order_id % 17 == 0:
                continue
            size = 600 if order_id == 1 else rng.randint(1, 9)
            for place in range(1, size + 1):
                product = 1 if rng.random() < 0.33 else rng.randint(1, 40)
                lines.append((order_id, product, place, rng.randint(0, 1)))
    lines += [(2, 1000, 50, 1), (2, 99, 51, 1)]
    return {
        "aisles": spark.createDataFrame(
            [(a, f"aisle {a}") for a in range(1, 10)], TABLE_COLUMNS["aisles"]
        ),
        "departments": spark.createDataFrame(
            [(d, f"department {d}") for d in range(1, 5)], TABLE_COLUMNS["departments"]
        ),
        "products": spark.createDataFrame(products, TABLE_COLUMNS["products"]),
        "orders": orders_frame(spark, orders).repartition(4, "order_id").cache(),
        "order_products_prior": lines_frame(spark, lines).repartition(6).cache(),
    }


def plan_of(df) -> str:
    """The physical plan; with adaptive execution on, the final one if ``df`` has run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("+- == Initial Plan ==")[0]
