"""The registered queries against DuckDB over whole tables, and the pipeline stage by stage."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from trolley.llm.near_dups_sql import NEAR_DUPLICATES_SQL
from trolley.llm.queries import FURTHER, ORACLES, QUERIES

ROOT = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def duck(root):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return connection


def same(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(same(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_duckdb(spark, name):
    result = (QUERIES | FURTHER)[name](spark, ROOT)
    expected = duck(ROOT).sql(ORACLES[name])
    assert by_name(result.columns, result.collect()) == by_name(
        expected.columns, expected.fetchall()
    )


def test_all_are_registered():
    names = driver.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_targets_of_mixing_and_shards_at_small_scale(spark):
    mixed = QUERIES["op8_mixing"](spark, SMALL).collect()
    shards = QUERIES["op5_sharding"](spark, SMALL).collect()
    assert len(mixed) == len(shards) == 200
    size, words = Counter(), sum(r.size for r in mixed)
    for r in shards:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= max(r.size for r in shards)
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * words, rel=0.01)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows follow from its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == columns
    bad = {
        r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()
    }
    before, after = seen["quality"]
    kept = {r.doc_id for r in after.collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(kept & bad) <= 0.1 * len(bad)
    assert len(kept & (labelled - bad)) >= 0.95 * len(labelled - bad)
    before, after = seen["exact_dedup"]
    largest = {}
    for r in before.collect():
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert {r.doc_id for r in after.collect()} == set(largest.values())
    before, after = seen["near_dedup"]
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/exact_dedup/*.parquet'")
    groups = {row[-1] for row in tables.sql(NEAR_DUPLICATES_SQL).fetchall()}
    assert {r.doc_id for r in after.collect()} == groups
    before, after = seen["mixing"]
    copies = Counter(r.doc_id for r in after.collect())
    assert set(copies) <= {r.doc_id for r in before.collect()}
    assert set(copies.values()) <= {1, 2}
    before, after = seen["sentencepiece"]
    assert Counter((r.doc_id, r.text) for r in before.collect()) == Counter(
        (r.doc_id, r.text) for r in after.collect()
    )


def test_pipeline_runs(spark):
    result = corpus_pipeline.run(spark, SMALL)
    assert result.count() > 50


@pytest.mark.parametrize("given", ["edges", "nothing"])
def test_stages_take_awkward_documents(spark, request, tmp_path, given):
    """Null and empty texts, null ids and sources, repeated rows, clashing columns; no rows."""
    docs = request.getfixturevalue(given)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "sentencepiece":
            assert docs.columns == columns
        assert docs.count() <= 2 * n
    assert docs.columns == ["doc_id", "ids", "score", "text"]
    if given == "edges":
        assert {r.doc_id for r in docs.collect()} & {8, 9, 11}
