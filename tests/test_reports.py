"""Reports on a small shop with hot keys, against plain Python, and their two forms."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.data import lines_frame, orders_frame, plan_of, rows
from trolley.functions import cached
from trolley.operators.windows import hot_keys
from trolley.plans import reports, sqltext


@pytest.fixture(scope="module")
def facts(shop):
    """Lines joined by hand: (line, order, product or None, department or None)."""
    orders = {r.order_id: r for r in shop["orders"].collect()}
    products = {r.product_id: r for r in shop["products"].collect()}
    departments = {r.department_id: r.department for r in shop["departments"].collect()}
    out = []
    for line in shop["order_products_prior"].collect():
        product = products.get(line.product_id)
        department = departments.get(product.department_id) if product else None
        out.append((line, orders[line.order_id], product, department))
    return out


def totals(keyed):
    """{key: (lines, reorder rate)} from (key, reordered) pairs."""
    seen = defaultdict(list)
    for key, reordered in keyed:
        seen[key].append(reordered)
    return {key: (len(v), sum(v) / len(v)) for key, v in seen.items()}


def as_rows(by_key):
    return sorted(((*key, *values) for key, values in by_key.items()), key=repr)


def test_weekend_lunch(shop, facts):
    sizes = Counter(line.order_id for line, *_ in facts)
    expected = sorted(
        o.order_id
        for o in shop["orders"].collect()
        if o.order_dow in (0, 1) and 11 <= o.order_hour_of_day <= 14 and sizes[o.order_id] > 3
    )
    found = reports.weekend_lunch_baskets(shop, min_items=3)
    assert expected and [r[0] for r in sorted(found.collect())] == expected
    assert all(r.basket_size == sizes[r.order_id] for r in found.collect())


def test_profile(shop):
    orders = shop["orders"].collect()
    gaps = [o.days_since_prior_order for o in orders if o.days_since_prior_order is not None]
    assert rows(reports.order_profile(shop)) == [
        (
            len(orders),
            len({o.user_id for o in orders}),
            sum(gaps) / len(gaps),
            min(o.order_hour_of_day for o in orders),
            max(o.order_hour_of_day for o in orders),
            sum(o.order_dow in (0, 1) for o in orders),
        )
    ]


def test_profile_of_no_orders(spark, shop):
    empty = {**shop, "orders": orders_frame(spark, [])}
    assert rows(reports.order_profile(empty)) == [(0, 0, None, None, None, None)]


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_department_hours(shop, facts, max_bytes):
    expected = totals(
        ((d, o.order_dow, o.order_hour_of_day), line.reordered) for line, o, _, d in facts if d
    )
    assert rows(reports.department_hours(shop, max_bytes)) == as_rows(expected)


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_product_reorders(shop, facts, max_bytes):
    expected = Counter()
    for line, _, product, department in facts:
        if department:
            expected[department, product.product_id, product.product_name] += line.reordered
    found = rows(reports.product_reorders(shop, max_bytes))
    assert found == sorted(((*k, v) for k, v in expected.items()), key=repr)


def test_top_products(shop):
    by_department = defaultdict(list)
    for row in reports.product_reorders(shop).collect():
        by_department[row.department].append(row)
    with_ties, exact = [], []
    for found in by_department.values():
        for r in found:
            above = sum(o.total_reorders > r.total_reorders for o in found)
            before = above + sum(
                o.total_reorders == r.total_reorders and o.product_id < r.product_id
                for o in found
            )
            with_ties += [(*r, above + 1)] * (above < 5)
            exact += [(*r, before + 1)] * (before < 5)
    assert rows(reports.top_products(shop)) == sorted(with_ties, key=repr)
    assert rows(reports.top_products_exact(shop)) == sorted(exact, key=repr)
    assert len(exact) == 20


def running_by_hand(shop, facts):
    sizes = Counter(line.order_id for line, *_ in facts)
    per_user = defaultdict(list)
    for o in shop["orders"].collect():
        if sizes[o.order_id]:
            per_user[o.user_id].append((o.order_number, o.order_ts, sizes[o.order_id]))
    expected = []
    for user, orders in per_user.items():
        total = 0
        for n, (number, ts, size) in enumerate(sorted(orders), 1):
            total += size
            expected.append((user, number, ts, size, total / n, total))
    return sorted(expected, key=repr)


def test_running_basket(spark, shop, facts):
    expected = running_by_hand(shop, facts)
    assert rows(reports.running_basket(shop)) == expected
    hot = hot_keys(shop["orders"], "user_id", 20)
    assert rows(hot)[0][0] == 1
    split = reports.running_basket(shop, hot=hot, numbers_per_block=7, ids_per_block=9, max_rows=4)
    assert rows(split) == expected
    as_sql = sqltext.running_basket(
        spark, shop, hot=hot, numbers_per_block=7, ids_per_block=9, max_rows=4
    )
    assert rows(as_sql) == expected


def test_running_basket_of_a_user_who_is_many(spark, shop):
    """A third of the orders have no user; they share a few order numbers."""
    lost = F.col("order_id") % 3 == 0
    t = {**shop, "orders": shop["orders"].withColumn("user_id", F.when(~lost, F.col("user_id")))}
    assert t["orders"].where("user_id IS NULL").count() > 80
    plain = (
        Window.partitionBy("user_id")
        .orderBy("order_number", "order_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sized = reports.sized_orders(t, "user_id", "order_number", "order_ts")
    expected = rows(
        sized.select(
            "user_id",
            "order_number",
            "order_ts",
            "basket_size",
            F.avg("basket_size").over(plain),
            F.sum("basket_size").over(plain),
        )
    )
    hot = hot_keys(t["orders"], "user_id", 20)
    assert (None, True) in rows(hot)
    for size in (3, 1000):
        options = {"hot": hot, "numbers_per_block": size, "ids_per_block": size, "max_rows": 9}
        assert rows(reports.running_basket(t, **options)) == expected
        assert rows(sqltext.running_basket(spark, t, **options)) == expected


def test_last_running_total_is_the_users_line_count(shop):
    last = reports.running_basket(shop).groupBy("user_id").agg(F.max("cumulative_items"))
    counts = reports.user_line_counts(reports.orders_with_line_counts(shop))
    assert rows(last) == rows(counts)


def test_power_users(shop, facts):
    sizes = defaultdict(Counter)
    for line, order, *_ in facts:
        sizes[order.user_id][order.order_id] += 1
    means = {u: sum(c.values()) / len(c) for u, c in sizes.items()}
    overall = sum(means.values()) / len(means)
    expected = sorted(((u, m) for u, m in means.items() if m > overall), key=repr)
    assert rows(reports.power_users(shop)) == expected
    found = reports.power_users_with_average(shop)
    assert rows(found, "user_id", "user_avg_basket") == expected
    assert {round(r.global_avg, 9) for r in found.collect()} == {round(overall, 9)}


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_lines_per_aisle(shop, facts, max_bytes):
    expected = Counter(f"aisle {p.aisle_id}" for _, _, p, _ in facts if p)
    found = [tuple(r) for r in reports.lines_per_aisle(shop, max_bytes).collect()]
    assert found == sorted(expected.items(), key=lambda kv: (-kv[1], kv[0]))
    assert sum(n for _, n in found) == sum(1 for _, _, p, _ in facts if p)
    assert rows(reports.aisle_lines(shop, max_bytes)) == sorted(expected.items())


def test_reorder_rate_by_day(shop, facts):
    expected = totals(((o.order_dow,), line.reordered) for line, o, *_ in facts)
    assert rows(reports.reorder_rate_by_day(shop)) == as_rows(expected)


def test_rate_is_null_where_no_flag_is_known(spark, shop):
    lines = lines_frame(spark, [(1, 1, 1, None), (1, 2, 2, None)])
    found = reports.reorder_rate_by_day({**shop, "order_products_prior": lines})
    assert [r.reorder_rate for r in found.collect()] == [None]


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_product_days(shop, facts, max_bytes):
    expected = totals(
        ((line.product_id, o.order_dow), line.reordered) for line, o, p, _ in facts if p
    )
    assert rows(reports.product_days(shop, max_bytes)) == as_rows(expected)


def test_counts(shop, facts):
    assert rows(reports.reordered_line_count(shop)) == [
        (sum(line.reordered for line, *_ in facts),)
    ]
    expected = defaultdict(lambda: [0, 0])
    for line, *_ in facts:
        expected[line.product_id][0] += 1
        expected[line.product_id][1] += line.reordered
    assert rows(reports.product_totals(shop)) == sorted(
        ((k, *v) for k, v in expected.items()), key=repr
    )


def test_repeated_keys_count_as_in_a_row_level_join(spark, shop):
    """Reducing lines before a join must not change what repeated dimension rows count for."""
    t = {
        **shop,
        "orders": shop["orders"].union(shop["orders"].where("order_id <= 40")),
        "products": shop["products"].union(shop["products"].where("product_id <= 3")),
    }
    lines = t["order_products_prior"]
    plain = (
        lines.join(t["orders"], "order_id")
        .groupBy("order_dow")
        .agg(F.count("*"), F.avg("reordered"))
    )
    assert rows(reports.reorder_rate_by_day(t)) == rows(plain)
    plain = (
        lines.join(t["products"], "product_id").join(t["aisles"], "aisle_id").groupBy("aisle")
    ).count()
    for max_bytes in (0, 10**9):
        assert rows(reports.aisle_lines(t, max_bytes)) == rows(plain)
    plain = (
        lines.join(t["orders"], "order_id")
        .join(t["products"], "product_id")
        .groupBy("product_id", "order_dow")
        .agg(F.count("*"), F.avg("reordered"))
    )
    for max_bytes in (0, 10**9):
        assert rows(reports.product_days(t, max_bytes)) == rows(plain)


def test_user_ids_may_be_strings(spark, shop):
    named = shop["orders"].withColumn("user_id", F.concat(F.lit("u"), "user_id"))
    t = {**shop, "orders": named}
    found = reports.running_basket(t)
    assert rows(sqltext.running_basket(spark, t)) == rows(found)
    assert found.count() == reports.running_basket(shop).count()


def test_user_line_counts(shop, facts):
    per_user = Counter(o.user_id for _, o, *_ in facts)
    counts = reports.user_line_counts(reports.orders_with_line_counts(shop))
    assert rows(counts) == sorted(per_user.items(), key=repr)


def test_cached_block_reads_the_cache_and_frees_it(spark, shop):
    joined = reports.orders_with_line_counts(shop)
    with cached(joined) as kept:
        kept.count()
        counts = reports.user_line_counts(kept)
        assert "InMemoryTableScan" in counts._jdf.queryExecution().executedPlan().toString()
        inside = rows(counts)
    assert not joined.storageLevel.useMemory
    assert rows(reports.user_line_counts(joined)) == inside


def test_products_of_department(spark, shop, tmp_path):
    expected = rows(shop["products"].where("department_id = 4"))
    path = str(tmp_path / "products")
    found = reports.products_of_department(shop, path)
    assert found.columns == ["product_id", "product_name", "aisle_id", "department_id"]
    assert rows(found) == expected
    assert rows(sqltext.products_of_department(spark, shop, path)) == expected
    assert rows(reports.hashed_products_of_department(shop)) == expected


def test_partitioned_copy_is_never_stale(spark, shop, tmp_path):
    path = str(tmp_path / "products")
    reports.products_of_department(shop, path).collect()
    fewer = {**shop, "products": shop["products"].where("product_id < 10")}
    found = reports.products_of_department(fewer, path)
    assert rows(found) == rows(fewer["products"].where("department_id = 4"))


SQL_TWINS = [
    (lambda s, t: sqltext.weekend_lunch_baskets(s, t, min_items=3),
     lambda t: reports.weekend_lunch_baskets(t, min_items=3)),
    (sqltext.order_profile, reports.order_profile),
    (sqltext.department_hours, reports.department_hours),
    (lambda s, t: sqltext.department_hours(s, t, max_bytes=0), reports.department_hours),
    (lambda s, t: sqltext.top_products(s, t).withColumnRenamed("rk", "rank"),
     reports.top_products),
    (sqltext.running_basket, reports.running_basket),
    (sqltext.power_users, reports.power_users),
    (sqltext.lines_per_aisle, reports.lines_per_aisle),
    (lambda s, t: sqltext.lines_per_aisle(s, t, max_bytes=0), reports.lines_per_aisle),
    (sqltext.reorder_rate_by_day, reports.reorder_rate_by_day),
    (lambda s, t: sqltext.weekend_lunch_baskets(s, t, 2, days=(3, 6), hours=(0, 20)),
     lambda t: reports.weekend_lunch_baskets(t, 2, days=(3, 6), hours=(0, 20))),
    (lambda s, t: sqltext.weekend_lunch_baskets(s, t, 2, days=()),
     lambda t: reports.weekend_lunch_baskets(t, 2, days=())),
    (lambda s, t: sqltext.order_profile(s, t, days=(2,)),
     lambda t: reports.order_profile(t, days=(2,))),
]


@pytest.mark.parametrize("as_sql, as_frame", SQL_TWINS)
def test_sql_text_equals_dataframe(spark, shop, as_sql, as_frame):
    sql, frame = as_sql(spark, shop), as_frame(shop)
    assert sql.columns == frame.columns
    assert rows(sql) == rows(frame)


def test_two_cached_views_at_once(spark, shop):
    """Each caller has a view of its own over its own tables, and leaves nothing behind."""
    fewer = {**shop, "orders": shop["orders"].where("user_id > 1")}
    before = {t.name for t in spark.catalog.listTables()}
    with (
        sqltext.cached_order_sizes(spark, shop) as one,
        sqltext.cached_order_sizes(spark, fewer) as two,
    ):
        assert spark.catalog.isCached(one) and spark.catalog.isCached(two)
        for view, tables in ((one, shop), (two, fewer)):
            expected = reports.user_line_counts(reports.orders_with_line_counts(tables))
            found = sqltext.user_line_counts(spark, view)
            assert rows(found) == rows(expected)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_results_over_two_table_sets_at_once(spark, shop):
    """Lazy results keep their tables when others are asked about, and caches stay cached."""
    orders = orders_frame(spark, shop["orders"].collect()).cache()
    shop = {**shop, "orders": orders}
    fewer = {**shop, "orders": orders.where("user_id > 1")}
    hot = [hot_keys(t["orders"], "user_id", 10) for t in (shop, fewer)]
    both = [
        sqltext.running_basket(spark, t, hot=h, numbers_per_block=7, max_rows=3)
        for t, h in zip((shop, fewer), hot)
    ]
    for found, t in zip(both, (shop, fewer)):
        assert rows(found) == rows(reports.running_basket(t))
    assert orders.storageLevel.useMemory
    assert "InMemoryTableScan" in plan_of(orders.select("order_id"))
    orders.unpersist()


def test_days_reach_the_scan(spark, shop, tmp_path):
    for name, df in shop.items():
        df.write.parquet(str(tmp_path / name))
    t = {name: spark.read.parquet(str(tmp_path / name)) for name in shop}
    plan = plan_of(sqltext.weekend_lunch_baskets(spark, t))
    assert "In(order_dow, [0,1])" in plan


@pytest.mark.parametrize("form", ["frame", "sql"])
def test_running_totals_need_one_shuffle_of_the_orders(conf, spark, shop, form):
    """The window's shuffle serves the join with the totals of earlier blocks."""
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    hot = hot_keys(shop["orders"], "user_id", 10)
    cut = {"hot": hot, "numbers_per_block": 7, "max_rows": 3}
    found = (
        reports.running_basket(shop, **cut)
        if form == "frame"
        else sqltext.running_basket(spark, shop, **cut)
    )
    rows_side = plan_of(found).split("SortMergeJoin")[1].split("Exchange")[0]
    assert "LeftOuter" in rows_side and "Window [" in rows_side
