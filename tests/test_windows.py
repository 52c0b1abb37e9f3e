"""Skew-safe windows give what the plain window gives, hot keys or not."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.data import plan_of, rows
from trolley.operators.windows import hot_keys, mark_hot, running_totals, top_n

COLUMNS = ["k", "at", "id", "v"]


@pytest.fixture(scope="module")
def events(spark):
    """Keys 1 and NULL hold a third of the rows each; ``at`` has many ties and some NULLs."""
    rng = random.Random(3)
    data = [
        (
            rng.choice([1, None, rng.randint(2, 40)]),
            rng.choice([None, *range(60)]),
            i,
            rng.choice([None, rng.randint(-5, 20)]),
        )
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "k INT, at INT, id INT, v INT").repartition(5).cache()


def cuts(fine):
    """Ways to cut a key: into blocks, nested blocks, and doubly nested blocks."""
    tens, ones = F.floor(F.col("at") / 10), F.floor(F.col("at") / 3)
    return {"one": [tens], "two": [tens, fine], "three": [tens, ones, fine]}


def running(df, max_rows, peers, order_by, cut="one", **kwargs):
    return running_totals(
        mark_hot(df, "k", hot_keys(df, "k", max_rows)),
        key="k",
        order_by=order_by,
        totals={"total": F.col("v"), "n": F.lit(1)},
        blocks=cuts(F.col("at") if peers else F.struct("at", F.floor(F.col("id") / 50)))[cut],
        peers=peers,
        **kwargs,
    )


@pytest.mark.parametrize("cut", ["one", "two", "three"])
@pytest.mark.parametrize("max_rows", [0, 200, 10**6])
def test_rows_frame(events, max_rows, cut):
    plain = (
        Window.partitionBy("k")
        .orderBy("at", "id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    expected = events.select(
        *COLUMNS, F.sum("v").over(plain).alias("total"), F.count("*").over(plain).alias("n")
    )
    assert rows(running(events, max_rows, False, ["at", "id"], cut)) == rows(expected)


@pytest.mark.parametrize("cut", ["one", "two", "three"])
@pytest.mark.parametrize("max_rows", [0, 200, 10**6])
def test_default_frame_includes_peers(events, max_rows, cut):
    plain = Window.partitionBy("k").orderBy("at")
    expected = events.select(
        *COLUMNS, F.sum("v").over(plain).alias("total"), F.count("*").over(plain).alias("n")
    )
    assert rows(running(events, max_rows, True, ["at"], cut)) == rows(expected)


@pytest.mark.parametrize("cut", ["one", "two", "three"])
@pytest.mark.parametrize("max_rows", [0, 200, 10**6])
def test_previous_row(events, max_rows, cut):
    plain = Window.partitionBy("k").orderBy("at", "id")
    expected = events.select(*COLUMNS, F.lag("at").over(plain).alias("before"))
    found = running(events, max_rows, False, ["at", "id"], cut, previous={"before": F.col("at")})
    assert rows(found, *COLUMNS, "before") == rows(expected)


def test_hot_keys_lists_null_and_the_hot_key(events):
    assert rows(hot_keys(events, "k", 200)) == rows(
        events.sparkSession.createDataFrame([(1, True), (None, True)], "k INT, hot BOOLEAN")
    )


def test_a_hot_key_is_spread_over_windows(conf, events):
    """Tasks sort blocks, not keys, and the earlier blocks' totals come to where the rows are."""
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(running(events, 200, False, ["at", "id"], "two"))
    by_block = r"hashpartitioning\(_key#\d+, _no_key#\d+, _block0#\d+, _block1#\d+"
    rows_side = plan.split("SortMergeJoin")[1].split("Exchange")[:2]
    assert "LeftOuter" in rows_side[0] and "Window [" in rows_side[0]
    assert re.search(by_block, rows_side[1])


def test_without_hot_keys_only_one_window_runs(events):
    result = running(events, 10**6, False, ["at", "id"])
    result.collect()
    plan = plan_of(result)
    assert plan.count("Window [") == 1
    assert "Join" not in plan


def test_peers_without_hot_keys_need_one_window_and_shuffle(events):
    result = running(events, 10**6, True, ["at"])
    result.collect()
    plan = plan_of(result)
    assert plan.count("Window [") == 1
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan.split("InMemory")[0]
    assert plan.count("Exchange hashpartitioning(k#") == 1


@pytest.mark.parametrize("ties, kept", [(True, 6), (False, 5)])
def test_top_n_with_and_without_ties(spark, ties, kept):
    """Seven rows; the sixth ties with the fifth."""
    data = [("d", p, c) for p, c in enumerate([90, 80, 70, 60, 50, 50, 10])]
    df = spark.createDataFrame(data, "d STRING, p INT, c INT")
    best = [F.col("c").desc()] + ([] if ties else [F.col("p")])
    found = top_n(df, "d", best, 5, ties)
    assert [r.p for r in found.orderBy("p").collect()] == list(range(kept))
    assert [r["rank"] for r in found.orderBy("p").collect()] == [1, 2, 3, 4, 5, 5][:kept]


def test_top_n_drops_losers_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("d"), F.col("id").alias("c"))
    plan = plan_of(top_n(df.repartition(4), "d", [F.col("c").desc()], 5, ties=True))
    assert plan.count("WindowGroupLimit") == 2
