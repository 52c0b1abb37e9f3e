from __future__ import annotations

import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tests.conftest import SF_SMALL
from tests.data import rows
from trolley.functions import scratch_path
from trolley.sources import (
    cluster_by_key,
    load_tables,
    sample_tables,
    write_csv,
    write_parquet,
    write_partitioned,
)
from trolley.sources.samples import number_orders
from trolley.sources.schemas import CSV_FILES, TABLE_COLUMNS, table_schema


@pytest.fixture
def csv_root(spark, shop, tmp_path):
    raw = {**shop, "orders": shop["orders"].drop("order_ts")}
    raw["order_products_train"] = raw["order_products_prior"].where("order_id <= 3")
    for name, file in CSV_FILES.items():
        write_csv(raw[name], str(tmp_path / file))
    return str(tmp_path), raw


def test_csv_comes_back_typed(spark, csv_root):
    root, raw = csv_root
    tables = load_tables(spark, root, format="csv")
    assert set(tables) == set(TABLE_COLUMNS)
    for name, df in tables.items():
        assert df.schema == table_schema(name)
        assert rows(df) == rows(raw[name])


def test_wide_ids_hold_keys_beyond_32_bits(spark, tmp_path):
    big = 5_000_000_000
    lines = spark.createDataFrame([(big, big + 1, 1, 0)], "order_id LONG, product_id LONG, "
                                  "add_to_cart_order INT, reordered INT")
    write_csv(lines, str(tmp_path / CSV_FILES["order_products_prior"]))
    found = load_tables(
        spark, str(tmp_path), format="csv", names=["order_products_prior"]
    )["order_products_prior"]
    assert rows(found) == rows(lines)
    kinds = {f.name: type(f.dataType) for f in found.schema}
    assert kinds["order_id"] is kinds["product_id"] is LongType
    assert kinds["reordered"] is IntegerType


def test_blank_key_is_null(spark, tmp_path):
    (tmp_path / "aisles.csv").write_text("aisle_id,aisle\n1,bread\n,unknown\n")
    aisles = load_tables(spark, str(tmp_path), format="csv", names=["aisles"])["aisles"]
    assert rows(aisles) == [(1, "bread"), (None, "unknown")]


def test_malformed_fields(spark, tmp_path):
    (tmp_path / "aisles.csv").write_text("aisle_id,aisle\n1,bread\n9999999999,too long\n")
    options = {"narrow_ids": True, "mode": "PERMISSIVE"}
    lenient = load_tables(spark, str(tmp_path), "csv", ["aisles"], **options)["aisles"]
    assert rows(lenient) == [(1, "bread"), (None, "too long")]
    strict = load_tables(spark, str(tmp_path), "csv", ["aisles"])["aisles"]
    with pytest.raises(Py4JJavaError, match="FAILFAST"):
        strict.collect()


def test_missing_tables_raise_unless_optional(spark, tmp_path):
    write_parquet(spark.range(3), str(tmp_path / "orders"))
    names = ["orders", "aisles"]
    for format in ("parquet", "csv"):
        with pytest.raises(AnalysisException):
            load_tables(spark, str(tmp_path), format=format, names=names, optional=["orders"])
    assert set(load_tables(spark, str(tmp_path), names=names, optional=["aisles"])) == {"orders"}
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), format="json")


def test_clustering_keeps_a_key_in_one_file(spark, shop, tmp_path):
    lines = shop["order_products_prior"]
    path = write_parquet(lines, str(tmp_path / "l"), cluster_key="order_id", partitions=16)
    found = spark.read.parquet(path)
    assert rows(found) == rows(lines)
    placed = found.select("order_id", F.input_file_name().alias("file"))
    files = placed.groupBy("order_id").agg(F.count_distinct("file").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1


AWKWARD = [" milk ", "", None, 'a "b", c', "two\nlines", "\\", '"', ",", "\\N", "é"]


def test_csv_keeps_awkward_names(spark, tmp_path):
    products = spark.createDataFrame(
        [(i, name, 1, None) for i, name in enumerate(AWKWARD)], TABLE_COLUMNS["products"]
    )
    write_csv(products, str(tmp_path / CSV_FILES["products"]))
    found = load_tables(spark, str(tmp_path), "csv", ["products"], multi_line=True)["products"]
    assert rows(found) == rows(products)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_clustering_keeps_its_number_of_parts(spark, conf, adaptive):
    conf("spark.sql.adaptive.enabled", adaptive)
    df = spark.range(0, 3000, 1, 8).select((F.col("id") % 300).alias("k"), "id")
    placed = cluster_by_key(df, "k", 16).withColumn("part", F.spark_partition_id())
    assert cluster_by_key(df, "k", 16).rdd.getNumPartitions() == 16
    parts = placed.groupBy("k").agg(F.count_distinct("part").alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1
    hot = df.withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("k")))
    spread = cluster_by_key(hot, "k", 16, max_rows=500).withColumn("part", F.spark_partition_id())
    assert spread.where("k = 7").agg(F.count_distinct("part")).first()[0] > 8


def test_partitioned_write_without_adaptive_execution(spark, conf, shop, tmp_path):
    conf("spark.sql.adaptive.enabled", "false")
    write_partitioned(shop["products"].repartition(20), str(tmp_path / "p"), "department_id")
    for folder in (tmp_path / "p").glob("department_id=*"):
        assert len(list(folder.glob("*.parquet"))) == 1


def test_clustering_spreads_a_hot_key(spark, conf):
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    ids = spark.range(0, 60_000, 1, 8)
    df = ids.select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    sizes = cluster_by_key(df, "k").groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 15_000
    assert sizes.agg(F.sum("count")).first()[0] == 60_000


def test_partitioned_write_makes_few_files(spark, shop, tmp_path):
    path = tmp_path / "p"
    write_partitioned(shop["products"].repartition(20), str(path), "department_id")
    folders = sorted(f for f in os.listdir(path) if "=" in f)
    assert folders == [f"department_id={d}" for d in (1, 2, 3, 4, 77)]
    assert all(
        sum(f.endswith(".parquet") for f in os.listdir(path / folder)) == 1 for folder in folders
    )


class Session:
    """A session with the given settings, for a cluster that tests do not have."""

    def __init__(self, settings):
        self.conf = settings


def test_scratch_paths_are_new_and_in_the_shared_folder():
    shared = Session({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://shared/tmp/"})
    first, second = scratch_path(shared, "x"), scratch_path(shared, "x")
    assert first != second
    assert first.startswith("hdfs://shared/tmp/trolley/") and first.endswith("/x")


def test_a_cluster_never_gets_a_local_folder():
    with pytest.raises(ValueError):
        scratch_path(Session({"spark.master": "yarn"}), "x")
    assert scratch_path(Session({"spark.master": "local[2]"}), "x").endswith("/x")


@pytest.mark.parametrize("hot_rows", [0, 12, 10**6])
def test_numbering_sample_orders(spark, hot_rows):
    """The same numbers and gaps whether no, some or all users are cut into blocks."""
    expected = spark.sql(f"""
        SELECT o_orderkey AS order_id,
            CAST(ROW_NUMBER() OVER w AS BIGINT) AS order_number,
            CAST(datediff(o_orderdate, LAG(o_orderdate) OVER w) AS DOUBLE) AS gap
        FROM parquet.`{SF_SMALL}/orders.parquet`
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
    orders = sample_tables(spark, SF_SMALL, numbered=True, hot_rows=hot_rows)["orders"]
    found = orders.select("order_id", "order_number", "days_since_prior_order")
    assert rows(found) == rows(expected)


def test_numbering_within_a_day(spark):
    """Blocks follow the time of day, not only the date."""
    orders = spark.sql("""
        SELECT id AS order_id, 1L AS user_id, 'x' AS eval_set, 0 AS order_dow,
            0 AS order_hour_of_day,
            TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(0, 0, 37 * (50 - id))
                AS order_ts
        FROM range(50)""")
    for hot_rows in (0, 100):
        numbered = number_orders(orders, hot_rows, ids_per_block=3)
        assert rows(numbered, "order_id", "order_number") == sorted(
            ((i, 50 - i) for i in range(50)), key=repr
        )
        gaps = numbered.orderBy("order_number").select("days_since_prior_order").collect()
        assert sum(g[0] or 0 for g in gaps) == 1 and gaps[0][0] is None


def test_sample_departments_are_ranked_types(spark):
    t = sample_tables(spark, SF_SMALL)
    names = [r.department for r in t["departments"].orderBy("department_id").collect()]
    assert names == sorted(names) and len(names) == 6
    assert t["products"].where("department_id IS NULL OR aisle_id IS NULL").count() == 0


def test_equal_rows_go_to_equal_parts_in_any_order(conf, spark):
    """What a task that runs again writes does not depend on the order of its input."""
    rows_in = [(1, i, f"row {i}", {"k": i}, [float(i)]) for i in range(400)]
    schema = "k INT, i INT, s STRING, m MAP<STRING, INT>, a ARRAY<DOUBLE>"

    def parts(data, slices):
        df = spark.createDataFrame(spark.sparkContext.parallelize(data, slices), schema)
        dealt = cluster_by_key(df, "k", 5, max_rows=100)
        return {r.i: r.part for r in dealt.select("i", F.spark_partition_id().alias("part")).collect()}

    one = parts(rows_in, 3)
    assert one == parts(rows_in[::-1], 7)
    assert len(set(one.values())) == 5


def test_malformed_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "products.csv").write_text(
        "product_id,product_name,aisle_id,department_id\n"
        '1,"a, ""b""",2,3\n'
        "x2,c,2,3\n"
        "3,d,2\n"
        "4,,2,\n"
        '5,"",2,3,9\n'
        "6,e,2,3\n"
    )
    into = str(tmp_path / "parsed")
    found = load_tables(spark, str(tmp_path), "csv", ["products"], quarantine=into)
    assert rows(found["products"]) == [
        (1, 'a, "b"', 2, 3),
        (4, None, 2, None),
        (6, "e", 2, 3),
    ]
    assert found["products"].schema == table_schema("products")
    assert found["products_rejected"].count() == 3
    assert rows(found["products_rejected"]) == [('5,"",2,3,9',), ("3,d,2",), ("x2,c,2,3",)] or {
        r.line for r in found["products_rejected"].collect()
    } == {"3,d,2", '5,"",2,3,9', "x2,c,2,3"}


def test_quarantine_of_a_good_and_of_an_empty_file(spark, tmp_path):
    header = "aisle_id,aisle\n"
    for text, n in ((header + "1,bread\n", 1), (header, 0)):
        (tmp_path / "aisles.csv").write_text(text)
        into = scratch_path(spark, "parsed")
        found = load_tables(spark, str(tmp_path), "csv", ["aisles"], quarantine=into)
        assert (found["aisles"].count(), found["aisles_rejected"].count()) == (n, 0)
    with pytest.raises(AnalysisException):
        load_tables(spark, str(tmp_path), "csv", ["orders"], quarantine=into)
    found = load_tables(
        spark, str(tmp_path), "csv", ["orders"], optional=["orders"], quarantine=into
    )
    assert found == {}
