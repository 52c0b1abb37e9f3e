"""Frequent itemsets against brute force on small baskets."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest

from tests.data import rows
from trolley.operators import itemsets
from trolley.plans import reports


@pytest.fixture(scope="module")
def bought(spark):
    """Order 0 buys everything; ``x`` and ``y`` go together; every third line is a repeat."""
    rng = random.Random(11)
    pairs = [(0, f"rare {i}") for i in range(300)]
    for order in range(200):
        pairs += [(order, rng.choice("abcdefgh")) for _ in range(rng.randint(1, 6))]
        if order % 4 == 0:
            pairs += [(order, "x"), (order, "y")]
    pairs += pairs[::3]
    rng.shuffle(pairs)
    return spark.createDataFrame(pairs, "order_id INT, item STRING").cache()


def by_order(bought):
    sets = {}
    for order, item in bought.collect():
        sets.setdefault(order, set()).add(item)
    return list(sets.values())


def test_baskets_leave_out_rare_items_only(bought, tmp_path):
    found = itemsets.baskets(bought.distinct(), 0.05, str(tmp_path / "items")).collect()
    assert len(found) == 200
    assert all(len(r["items"]) == len(set(r["items"])) for r in found)
    hot = next(r for r in found if r.order_id == 0)
    assert not any(item.startswith("rare") for item in hot["items"])
    kept = {item for r in found for item in r["items"]}
    assert kept == {*"abcdefgh", "x", "y"}


@pytest.mark.parametrize("support", [0.02, 0.1, 0.25])
def test_frequent_pairs(bought, tmp_path, support):
    sets = by_order(bought)
    counts = Counter(p for s in sets for p in combinations(sorted(s), 2))
    needed = math.ceil(support * len(sets))
    expected = sorted((*p, n) for p, n in counts.items() if n >= needed)
    model = itemsets.mine(bought, support, str(tmp_path / "b"))
    assert rows(itemsets.frequent_pairs(model)) == expected


def test_larger_itemsets(bought, tmp_path):
    sets = by_order(bought)
    needed = math.ceil(0.05 * len(sets))
    common = [sorted(s & set("abcdefghxy")) for s in sets]
    counts = Counter(c for s in common for n in (1, 2, 3, 4) for c in combinations(s, n))
    expected = {c: n for c, n in counts.items() if n >= needed}
    model = itemsets.mine(bought, 0.05, str(tmp_path / "b"))
    found = {tuple(r["items"]): r.baskets for r in itemsets.frequent_itemsets(model).collect()}
    assert {c: n for c, n in found.items() if len(c) <= 4} == expected


def test_support_is_checked(bought):
    for support in (0, -1, 1.5):
        with pytest.raises(ValueError):
            itemsets.baskets(bought, support, "unused")


def test_rules(bought, tmp_path):
    sets = by_order(bought)
    model = itemsets.mine(bought, 0.2, str(tmp_path / "b"), min_confidence=0.9)
    found = {(r.antecedent, r.consequent): r for r in itemsets.rules(model).collect()}
    assert set(found) == {("x", "y"), ("y", "x")}
    rule = found["x", "y"]
    both = sum({"x", "y"} <= s for s in sets) / len(sets)
    assert rule.confidence == 1.0
    assert rule.support == round(both, 9)
    assert rule.lift == round(1 / (sum("y" in s for s in sets) / len(sets)), 9)


def test_aisles_of_orders(shop):
    found = reports.order_aisles(shop)
    assert found.columns == ["order_id", "item"]
    products = {r.product_id: r.aisle_id for r in shop["products"].collect()}
    expected = [
        (line.order_id, f"aisle {products[line.product_id]}")
        for line in shop["order_products_prior"].collect()
        if line.product_id in products
    ]
    assert rows(found) == sorted(expected, key=repr)
