"""The plans behind the results: join strategies, pruning, reuse, early reduction."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.data import make_tables, plan_of, rows
from trolley.functions import broadcast_if_small, fits_broadcast, sizing
from trolley.operators import itemsets
from trolley.plans import reports, sqltext
from trolley.sources import load_tables, sample_tables, write_parquet


@pytest.fixture
def static(conf):
    """Plain plans: without adaptive execution the plan is final before it runs."""
    conf("spark.sql.adaptive.enabled", "false")


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """The small shop as Parquet files."""
    root = str(tmp_path_factory.mktemp("shop"))
    tables = make_tables(spark)
    for name, df in tables.items():
        write_parquet(df, f"{root}/{name}")
    return load_tables(spark, root, names=tables)


def scans(plan):
    return re.findall(r"FileScan parquet \[.*", plan)


def test_lunch_filter_reaches_the_scan(static, shop):
    plan = plan_of(reports.weekend_lunch_baskets(shop))
    orders = next(s for s in scans(plan) if "order_dow" in s.split("]")[0])
    for pushed in ("In(order_dow, [0,1])", "GreaterThanOrEqual(order_hour_of_day,11)",
                   "LessThanOrEqual(order_hour_of_day,14)"):
        assert pushed in orders
    lines = next(s for s in scans(plan) if "order_dow" not in s.split("]")[0])
    assert lines.endswith("ReadSchema: struct<order_id:int>")


def test_reordered_filter_reaches_the_scan(spark, static, shop):
    assert "EqualTo(reordered,1)" in plan_of(reports.reordered_line_count(shop))
    sample = plan_of(reports.reordered_line_count(sample_tables(spark, SF_SMALL)))
    assert "EqualNullSafe(l_returnflag,R)" in sample


def test_top_products_reduces_before_each_shuffle(static, shop):
    plan = plan_of(reports.top_products(shop))
    assert plan.count("WindowGroupLimit") == 2
    # Lines per product, groups per department, final sort: nothing else is shuffled.
    assert len(re.findall(r"Exchange (?:hash|range)partitioning", plan)) == 3


def test_small_aisles_are_broadcast(spark, static, shop):
    for result in (reports.lines_per_aisle(shop), sqltext.lines_per_aisle(spark, shop)):
        plan = plan_of(result)
        assert plan.count("BroadcastHashJoin") == 2
        assert "SortMergeJoin" not in plan


def test_large_tables_are_not_broadcast(spark, conf, static, shop):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    results = [
        reports.lines_per_aisle(shop, max_bytes=0),
        reports.department_hours(shop, max_bytes=0),
        reports.product_days(shop, max_bytes=0),
        sqltext.lines_per_aisle(spark, shop, max_bytes=0),
        sqltext.department_hours(spark, shop, max_bytes=0),
    ]
    for result in results:
        assert "Broadcast" not in plan_of(result)


def test_size_check(shop):
    products = shop["products"]
    assert fits_broadcast(products)
    assert not fits_broadcast(products, max_bytes=10)
    assert broadcast_if_small(products, max_bytes=10) is products
    # A join of two small tables is estimated at the product of their sizes: never too small.
    assert not fits_broadcast(products.join(shop["aisles"], "aisle_id"), 100_000)


def test_reorder_rate_is_a_merge_join_on_reduced_lines(spark, static, shop):
    for result in (reports.reorder_rate_by_day(shop), sqltext.reorder_rate_by_day(spark, shop)):
        plan = plan_of(result)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        # One shuffle serves the grouping of the lines and the join; the other is the orders'.
        assert len(re.findall(r"Exchange hashpartitioning\(order_id", plan)) == 2


def test_the_merge_hint_survives_adaptive_execution(shop):
    result = reports.reorder_rate_by_day(shop)
    result.collect()
    assert "SortMergeJoin" in plan_of(result)


def test_power_users_compute_the_averages_once(spark, static, shop):
    for result in (reports.power_users(shop), reports.power_users_with_average(shop),
                   sqltext.power_users(spark, shop)):
        assert "ReusedExchange" in plan_of(result)


def test_only_the_one_row_side_meets_a_nested_loop(static, shop):
    plan = plan_of(reports.power_users_with_average(shop))
    loop = plan.split("BroadcastNestedLoopJoin BuildRight")[1]
    assert "HashAggregate(keys=[], functions=[avg" in loop.split("BroadcastExchange Identity")[1]
    assert "CartesianProduct" not in plan


def test_one_department_is_pruned(spark, static, shop, tmp_path):
    path = str(tmp_path / "p")
    for result in (reports.products_of_department(shop, path),
                   sqltext.products_of_department(spark, shop, path)):
        assert re.search(r"PartitionFilters: \[.*department_id.* = 4\)\]", plan_of(result))


def test_product_aggregate_needs_no_second_shuffle(static, shop):
    plan = plan_of(reports.product_reorders(shop))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_plans_stay_in_the_jvm(spark, shop):
    for build in (reports.department_hours, reports.running_basket, reports.top_products):
        assert "Python" not in plan_of(build(shop))


def shuffles_of(result):
    result.collect()
    return len(re.findall(r"Exchange hashpartitioning", plan_of(result)))


def test_running_basket_shuffles_only_for_join_and_window(conf, shop):
    """Lines, orders and the joined result, plus the orders counted per user."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert shuffles_of(reports.running_basket(shop)) <= 4


def test_a_hot_order_is_split_by_the_adaptive_join(conf, spark):
    """Row-level joins rely on it: the partition of an order with most lines is cut up."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    ids = spark.range(0, 60_000, 1, 8)
    lines = ids.select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20_000).cast("int")
        .alias("order_id"),
        (F.col("id") % 50).cast("int").alias("product_id"),
        (F.col("id") % 2).cast("int").alias("reordered"),
    )
    orders = spark.range(0, 20_000, 1, 4).select(
        F.col("id").cast("int").alias("order_id"), (F.col("id") % 7).alias("order_dow")
    )
    products = spark.range(50).select(F.col("id").cast("int").alias("product_id"))
    t = {"order_products_prior": lines, "orders": orders, "products": products}
    result = reports.product_days(t)
    found = {tuple(r) for r in result.collect()}
    assert "SortMergeJoin(skew=true)" in plan_of(result)
    plain = (
        lines.join(orders, "order_id").groupBy("product_id", "order_dow")
        .agg(F.count("*"), F.avg("reordered"))
    )
    assert found == {tuple(r) for r in plain.collect()}


def test_without_a_handle_on_the_plan_nothing_is_hinted(conf, monkeypatch, shop):
    """As on a client apart from its driver: sizes are not known, joins are shuffled."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")

    class Apart:
        @property
        def _jdf(self):
            raise AttributeError("_jdf")

    assert sizing.estimated_bytes(Apart()) is None and not sizing.fits_broadcast(Apart())
    expected = rows(reports.department_hours(shop))
    assert "BroadcastHashJoin" in plan_of(reports.department_hours(shop))
    monkeypatch.setattr(sizing, "estimated_bytes", lambda df: None)
    found = reports.department_hours(shop)
    assert "BroadcastHashJoin" not in plan_of(found)
    assert rows(found) == expected


def test_a_hot_item_is_split(conf, spark, tmp_path):
    """Pairs of an item that most baskets have, with an item list too large to broadcast."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    pairs = spark.range(0, 90_000, 1, 8).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 5_000))
        .alias("item"),
    )
    found = itemsets.baskets(pairs, 1e-6, str(tmp_path / "items"), max_bytes=0)
    assert found.where(F.array_contains("items", "hot")).count() == 30_000
    made = itemsets.baskets(pairs, 1e-6, str(tmp_path / "again"), max_bytes=0)
    made.write.format("noop").mode("overwrite").save()
    made.collect()
    assert "SortMergeJoin(skew=true)" in plan_of(made)
