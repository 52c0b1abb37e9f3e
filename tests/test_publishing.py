"""Readers see whole sets of tables: the last one that was published."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SF_SMALL
from tests.data import rows
from trolley.operators import cleaning
from trolley.operators.cleaning import preprocess
from trolley.sources import load_tables, new_set, publish_set, published_set, write_parquet


@pytest.fixture
def raw(shop):
    return {**shop, "orders": shop["orders"].drop("order_ts")}


def test_a_failed_write_leaves_the_old_set(spark, raw, tmp_path):
    root = str(tmp_path)
    preprocess(raw, root, publish=True)
    old = {n: rows(df) for n, df in load_tables(spark, root, names=raw).items()}
    fail = F.raise_error(F.lit("no more")).cast("string")
    broken = {
        **raw,
        "aisles": raw["aisles"].where("aisle_id < 3"),
        "products": raw["products"].withColumn("product_name", fail),
    }
    with pytest.raises(Exception, match="no more"):
        preprocess(broken, root, publish=True)
    assert {n: rows(df) for n, df in load_tables(spark, root, names=raw).items()} == old


def test_the_last_set_counts(spark, raw, tmp_path):
    root = str(tmp_path)
    preprocess(raw, root, publish=True)
    reader = load_tables(spark, root, names=["aisles"])["aisles"]
    fewer = {**raw, "aisles": raw["aisles"].where("aisle_id < 3")}
    written = preprocess(fewer, root, publish=True)
    assert load_tables(spark, root, names=["aisles"])["aisles"].count() == 2
    assert written["wide"].select("aisle_id").distinct().count() == 2
    assert reader.count() == 9  # opened before; its files are still there


def test_without_sets_the_folder_itself_is_read(spark, raw, tmp_path):
    root = str(tmp_path)
    assert published_set(spark, root) is None
    preprocess(raw, root)
    assert published_set(spark, root) is None
    assert load_tables(spark, root, names=["aisles"])["aisles"].count() == 9


def test_sets_are_numbered(spark, shop, tmp_path):
    root, folders = str(tmp_path), []
    for n in range(3):
        folders.append(new_set(root))
        write_parquet(shop["aisles"].where(F.col("aisle_id") <= n), f"{folders[-1]}/aisles")
        publish_set(spark, root, folders[-1])
        assert published_set(spark, root) == folders[-1]
    assert load_tables(spark, root, names=["aisles"])["aisles"].count() == 2


def test_orders_of_both_sets_are_numbered_once(spark, monkeypatch):
    plans, prepare = [], cleaning.preprocess

    def noting(raw, *args, **options):
        plans.append(raw["orders"]._jdf.queryExecution().optimizedPlan().toString())
        return prepare(raw, *args, **options)

    monkeypatch.setattr(cleaning, "preprocess", noting)
    __spark_entry__.queries()["etl_published"](spark, SF_SMALL)
    assert len(plans) == 2
    assert not any("Window" in plan for plan in plans)
