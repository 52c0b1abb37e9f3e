"""Bucketed tables: the same rows, no shuffle on their key, and hot keys that stay splittable."""

from __future__ import annotations

import pytest

from tests.data import plan_of, rows
from trolley.plans import reports
from trolley.sources import read_bucketed, write_bucketed

TABLES = ("order_products_prior", "orders")


@pytest.fixture(scope="module")
def bucketed(spark, shop, tmp_path_factory):
    made = dict(shop)
    for name in TABLES:
        path = str(tmp_path_factory.mktemp("buckets") / name)
        made[name] = write_bucketed(shop[name], f"test_{name}", path, "order_id", 4)
    yield made
    for name in TABLES:
        spark.sql(f"DROP TABLE test_{name}")


REPORTS = [
    (lambda t: reports.weekend_lunch_baskets(t, 3), 0),
    (reports.running_basket, 1),
    (reports.reorder_rate_by_day, 0),
]


@pytest.mark.parametrize("report, others", REPORTS)
def test_no_shuffle_on_the_key(conf, shop, bucketed, report, others):
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = report(bucketed)
    plan = plan_of(found)
    assert "hashpartitioning(order_id" not in plan
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert rows(found) == rows(report(shop))


def test_each_bucket_is_one_file(spark, shop, tmp_path):
    write_bucketed(shop["orders"], "test_files", str(tmp_path / "o"), "order_id", 4)
    assert len(list((tmp_path / "o").glob("*.parquet"))) == 4
    spark.sql("DROP TABLE test_files")


def test_hot_keys_are_read_as_plain_files(conf, spark, shop, tmp_path):
    lines, path = shop["order_products_prior"], str(tmp_path / "lines")
    found = write_bucketed(lines, "test_hot", path, "order_id", 4, max_rows=100)
    assert rows(found) == rows(lines)
    assert "Bucketed: true" not in plan_of(found.groupBy("order_id").count())
    hot = found.where("order_id = 1").select("_metadata.file_path").distinct()
    assert hot.count() == 4
    assert rows(read_bucketed(spark, "test_hot")) == rows(lines)
    again = write_bucketed(lines, "test_hot", path, "order_id", 4)
    assert "Bucketed: true" in plan_of(again.groupBy("order_id").count())
    assert rows(again) == rows(lines)
    spark.sql("DROP TABLE test_hot")


def test_empty_table_and_null_keys(spark, shop, tmp_path):
    none = shop["orders"].where("false")
    assert write_bucketed(none, "test_none", str(tmp_path / "n"), "order_id", 4).count() == 0
    some = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "order_id INT, v INT")
    found = write_bucketed(some, "test_none", str(tmp_path / "m"), "order_id", 4)
    assert rows(found) == rows(some)
    spark.sql("DROP TABLE test_none")


def test_result_outlives_the_table(spark, shop, tmp_path):
    found = write_bucketed(shop["orders"], "test_gone", str(tmp_path / "o"), "order_id", 4)
    counted = found.groupBy("user_id").count()
    spark.sql("DROP TABLE test_gone")
    assert rows(counted) == rows(shop["orders"].groupBy("user_id").count())
