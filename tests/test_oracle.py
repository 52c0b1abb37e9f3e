"""Every registered query against its SQL in DuckDB, over the same whole tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from tests.conftest import SF_SMALL

ROOT = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(root):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


def by_name(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in found), key=repr)


def test_every_query_has_an_oracle():
    assert driver.order_queries().keys() <= driver.oracle_sql().keys()


def test_no_query_leaves_a_cache(spark):
    cache = spark._jsparkSession.sharedState().cacheManager()
    spark.catalog.clearCache()
    for name in ("q9_user_line_counts", "rdd_q9_basket_sizes", "sql_q9_cached_view"):
        driver.queries()[name](spark, SF_SMALL).collect()
        assert cache.isEmpty()


@pytest.mark.parametrize("name", list(driver.order_queries()))
def test_query_matches_duckdb(spark, duck, name):
    result = driver.queries()[name](spark, ROOT)
    expected = duck.sql(driver.oracle_sql()[name])
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: SAME_TYPE[t] for c, t in result.dtypes} == types
    found = by_name(result.columns, result.collect())
    assert found
    assert found == by_name(expected.columns, expected.fetchall())
    spark.catalog.clearCache()


def test_rules_from_larger_itemsets(spark, monkeypatch):
    """At lower thresholds the smallest tables have frequent sets of three items."""
    sql = driver.oracle_sql()["fp_rules"]
    for name, value in (("MIN_SUPPORT", 0.01), ("MIN_CONFIDENCE", 0.1)):
        sql = sql.replace(f"{getattr(driver, name)}", f"{value}")
        monkeypatch.setattr(driver, name, value)
    result = driver.queries()["fp_rules"](spark, SF_SMALL)
    expected = connect(SF_SMALL).sql(sql)
    found = by_name(result.columns, result.collect())
    assert any("," in antecedent for antecedent, *_ in found)
    assert found == by_name(expected.columns, expected.fetchall())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.count() == 1473
    assert result.columns == [
        "user_id",
        "order_number",
        "order_ts",
        "basket_size",
        "running_avg_basket",
        "cumulative_items",
    ]
