"""Sections of large hosts, and sections far down a path."""

from __future__ import annotations

import time

from trolley.llm import url_filters


def verdicts(spark, urls):
    """Verdicts by whether a page is bad. ``urls`` has pairs of url and label."""
    rows = [(i, url, bad) for i, (url, bad) in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, bad BOOLEAN")
    labels = pages.select("page_id", "bad")
    found = url_filters.judge_urls(pages.select("page_id", "url"), labels, {}).collect()
    assert len(found) == len(rows)
    seen = {}
    for r in found:
        seen.setdefault((urls[r.page_id][1]), set()).add(r.verdict)
    return seen, {r.template for r in found}


def test_a_section_is_judged_at_every_host_size(spark):
    section = [(f"http://big.com/casino/{i}", True) for i in range(30)]
    small = [(f"http://big.com/p{i}/x", False) for i in range(300)]
    large = [(f"http://big.com/p{i}/x", False) for i in range(6000)]
    for others in (small, large):
        assert verdicts(spark, section + others)[0] == {True: {"block"}, False: {"allow"}}


def test_a_section_below_the_third_segment(spark):
    urls = [
        (f"http://deep.com/en/2024/{i % 3}/a/{kind}/{i}", kind == "casino")
        for kind in ("casino", "news")
        for i in range(90)
    ]
    urls += [("http://deep.com/" + "/".join(f"s{i}" for i in range(200)), None)]
    seen, templates = verdicts(spark, urls)
    assert (seen[True], seen[False]) == ({"block"}, {"allow"})
    assert any(t.endswith("/casino/*") for t in templates)
    assert all(t.count("/") <= 6 for t in templates)


def test_sql_follows_the_same_rule(spark):
    """Sections of a host with thousands of pages, and nodes below the third segment."""
    import duckdb

    from trolley.llm.url_filters_sql import judge_urls_sql

    urls = [(f"http://big.com/casino/{i}", True) for i in range(30)]
    urls += [(f"http://big.com/p{i}/x", False) for i in range(3000)]
    urls += [
        (f"http://deep.com/en/2024/{i % 3}/a/{kind}/{i % 2}/end", kind == "casino")
        for kind in ("casino", "news")
        for i in range(90)
    ]
    pages = [(i, url) for i, (url, _) in enumerate(urls)]
    labels = [(i, 0 if bad else 1, 0) for i, (_, bad) in enumerate(urls)]
    connection = duckdb.connect()
    for name, rows, kind in (
        ("pages", pages, "page_id BIGINT, url VARCHAR"),
        ("labels", labels, "doc_id BIGINT, quality INT, toxic INT"),
    ):
        connection.execute(f"CREATE TABLE {name} ({kind})")
        connection.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    rules = {"nowhere.example/": "allow"}
    expected = connection.sql(judge_urls_sql(rules)).fetchall()
    found = url_filters.judge_urls(
        spark.createDataFrame(pages, "page_id LONG, url STRING"),
        spark.createDataFrame([(i, q == 0) for i, q, _ in labels], "page_id LONG, bad BOOLEAN"),
        rules,
    )
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def test_very_deep_paths_end(spark):
    """Traps with hundreds of segments, equal, random or alternating, take a few steps."""
    import random

    rng = random.Random(1)
    same = "/".join(f"s{i}" for i in range(500))
    urls = [(f"http://same.com/{same}", i % 2 == 0) for i in range(40)]
    urls += [
        ("http://any.com/" + "/".join(str(rng.random()) for _ in range(500)), None) for _ in range(40)
    ]
    urls += [
        ("http://mix.com/" + "/".join("user" if k % 2 else str(rng.random()) for k in range(300)), True)
        for _ in range(40)
    ]
    urls += [(f"http://mix.com/short/{i}", False) for i in range(60)]
    start = time.monotonic()
    seen, templates = verdicts(spark, urls)
    assert time.monotonic() - start < 60
    assert seen[True] == {"allow", "block"} and seen[False] == {"allow"}
    assert f"same.com/{'/'.join(['*'] * 500)}" in templates


def test_a_hot_host_can_be_split(spark, conf):
    """Pages meet verdicts in one join of two shuffled scans, which adaptive execution may split."""
    from tests.data import plan_of

    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    urls = [(i, f"http://hot.com/a?{i}" if i % 3 == 0 else f"http://h{i % 50}.com/b") for i in range(900)]
    pages = spark.createDataFrame(urls, "page_id LONG, url STRING")
    labels = spark.createDataFrame([], "page_id LONG, bad BOOLEAN")
    found = url_filters.judge_urls(pages, labels, {})
    assert len(found.collect()) == 900
    plan = plan_of(found)
    assert plan.count("SortMergeJoin") == 1 and "Aggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan parquet") == 2
