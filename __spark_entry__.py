"""

The queries run over the test tables ``orders``, ``lineitem`` and ``part``, seen as order
tables by ``trolley.sources.samples``. ``ORDER_TABLES`` is the same view of them in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from importlib.util import find_spec

from pyspark.ml.fpm import FPGrowthModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.functions import cached, scratch_path
from trolley.operators import cleaning, itemsets
from trolley.operators.lines import basket_sizes
from trolley.operators.windows import HOT_ROWS, hot_keys, mark_hot, running_totals
from trolley.plans import reports, sqltext
from trolley.plans.views import own_name
from trolley.sources import load_tables, sample_tables, write_bucketed, write_csv, write_parquet
from trolley.sources.schemas import CSV_FILES, TABLE_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]

RAW_ORDER_COLUMNS = [column.split()[0] for column in TABLE_COLUMNS["orders"].split(", ")]
MIN_ITEMS = 4
# About half of the pairs and of the rules over the test tables reach these.
MIN_SUPPORT = 0.022
MIN_CONFIDENCE = 0.148
# Small enough that the test tables take the way of hot users and of too large blocks.
CUT = {"numbers_per_block": 5, "ids_per_block": 1000, "max_rows": 3}
CUT_USERS = 12
# Every so many orders one has a malformed number in the file.
BAD_EVERY = 50
BUCKETS = 8
# Added to ids, which then exceed 32 bits.
FAR = 5_000_000_000


def entry(spark: SparkSession) -> DataFrame:
    """Running mean basket and cumulative items per user, at sf0.001."""
    return _running_basket(spark, "/root/testdata/sf0.001")


def _over(report: Callable[..., DataFrame], numbered: bool = False, **params: object) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        return report(sample_tables(spark, root, numbered), **params)

    return query


def _sql(report: Callable[..., DataFrame], numbered: bool = False, **params: object) -> Query:
    def query(spark: SparkSession, root: str) -> DataFrame:
        return report(spark, sample_tables(spark, root, numbered), **params)

    return query


def _hot_users(spark: SparkSession, root: str, max_rows: int = HOT_ROWS) -> DataFrame:
    """Taken from the plain orders: numbering them does not change how many a user has."""
    return hot_keys(sample_tables(spark, root)["orders"], "user_id", max_rows)


def _running_basket(spark: SparkSession, root: str) -> DataFrame:
    t = sample_tables(spark, root, numbered=True)
    return reports.running_basket(t, hot=_hot_users(spark, root))


def _sql_running_basket(spark: SparkSession, root: str) -> DataFrame:
    t = sample_tables(spark, root, numbered=True)
    return sqltext.running_basket(spark, t, hot=_hot_users(spark, root))


def _running_basket_cut(spark: SparkSession, root: str) -> DataFrame:
    t = sample_tables(spark, root, numbered=True)
    return reports.running_basket(t, hot=_hot_users(spark, root, CUT_USERS), **CUT)


def _sql_running_basket_cut(spark: SparkSession, root: str) -> DataFrame:
    t = sample_tables(spark, root, numbered=True)
    return sqltext.running_basket(spark, t, hot=_hot_users(spark, root, CUT_USERS), **CUT)


def _from_cache(
    build: Callable[..., DataFrame], report: Callable[[DataFrame], DataFrame], name: str
) -> Query:
    """Two actions over rows that stay cached between them and no longer."""

    def query(spark: SparkSession, root: str) -> DataFrame:
        with cached(build(sample_tables(spark, root))) as kept:
            kept.count()
            path = write_parquet(report(kept), scratch_path(spark, name))
        return spark.read.parquet(path)

    return query


def _sql_from_cache(spark: SparkSession, root: str) -> DataFrame:
    with sqltext.cached_order_sizes(spark, sample_tables(spark, root)) as view:
        counts = sqltext.user_line_counts(spark, view)
        path = write_parquet(counts, scratch_path(spark, "sql-counts"))
    return spark.read.parquet(path)


def _raw_orders(spark: SparkSession, root: str) -> DataFrame:
    return sample_tables(spark, root, numbered=True)["orders"].select(*RAW_ORDER_COLUMNS)


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return sample_tables(spark, root)["order_products_prior"]


def _etl_wide(spark: SparkSession, root: str) -> DataFrame:
    raw = {**sample_tables(spark, root), "orders": _raw_orders(spark, root)}
    hot = _hot_users(spark, root)
    return cleaning.preprocess(raw, scratch_path(spark, "clean"), hot=hot)["wide"]


def _order_time(spark: SparkSession, root: str) -> DataFrame:
    filled = cleaning.fill_first_gap(_raw_orders(spark, root))
    return cleaning.add_order_time(filled, hot=_hot_users(spark, root))


def _order_time_cut(spark: SparkSession, root: str) -> DataFrame:
    filled = cleaning.fill_first_gap(_raw_orders(spark, root))
    hot = _hot_users(spark, root, CUT_USERS)
    return cleaning.add_order_time(filled, hot=hot, numbers_per_block=CUT["numbers_per_block"])


def _through_csv(spark: SparkSession, name: str, df: DataFrame, **options: bool) -> DataFrame:
    folder = scratch_path(spark, "csv")
    write_csv(df, f"{folder}/{CSV_FILES[name]}")
    return load_tables(spark, folder, format="csv", names=[name], **options)[name]


def _csv_typed(spark: SparkSession, root: str) -> DataFrame:
    return _through_csv(spark, "orders", _raw_orders(spark, root))


def _csv_products(spark: SparkSession, root: str) -> DataFrame:
    """Names with spaces around them, quotes, nothing in them, line breaks, or NULL."""
    name, kind = F.col("product_name"), F.col("product_id") % 6
    awkward = (
        F.when(kind == 0, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(kind == 1, F.concat(F.lit('"'), name, F.lit('", "x"')))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.concat(name, F.lit("\n"), name))
        .when(kind == 4, name)
    )
    products = sample_tables(spark, root)["products"].withColumn("product_name", awkward)
    return _through_csv(spark, "products", products, multi_line=True)


def _csv_lines(spark: SparkSession, root: str) -> DataFrame:
    far = {key: F.col(key) + F.lit(FAR) for key in ("order_id", "product_id")}
    return _through_csv(
        spark, "order_products_prior", _lines(spark, root).withColumns(far)
    )


def _csv_with_bad_lines(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Orders through CSV, where some numbers have a letter before them."""
    number = F.col("order_number").cast("string")
    bad = F.when(F.col("order_id") % BAD_EVERY == 7, F.concat(F.lit("x"), number)).otherwise(number)
    folder = scratch_path(spark, "csv")
    orders = _raw_orders(spark, root).withColumn("order_number", bad)
    write_csv(orders, f"{folder}/{CSV_FILES['orders']}")
    return load_tables(spark, folder, "csv", ["orders"], quarantine=scratch_path(spark, "parsed"))


def _format_choice(spark: SparkSession, root: str) -> DataFrame:
    """Aisles from a folder that has them as CSV and as Parquet: the caller says which is read."""
    aisles, folder = sample_tables(spark, root)["aisles"], scratch_path(spark, "both")
    write_parquet(aisles.where("aisle_id % 2 = 0"), f"{folder}/aisles")
    write_csv(aisles.where("aisle_id % 2 = 1"), f"{folder}/{CSV_FILES['aisles']}")
    found = [
        load_tables(spark, folder, format, ["aisles"])["aisles"]
        .withColumn("aisle_id", F.col("aisle_id").cast("int"))
        .withColumn("format", F.lit(format))
        for format in ("csv", "parquet")
    ]
    return found[0].unionByName(found[1])


def _present_tables(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the tables that are there, of all that were asked for."""
    folder = scratch_path(spark, "some")
    for name in ("aisles", "departments", "products"):
        write_parquet(sample_tables(spark, root)[name], f"{folder}/{name}")
    tables = load_tables(spark, folder, optional=list(CSV_FILES))
    counted = [df.agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def _materialized(spark: SparkSession, root: str) -> DataFrame:
    """The number of rows of each table, by an action that runs and returns it."""
    tables = sample_tables(spark, root)
    return spark.createDataFrame([(n, df.count()) for n, df in tables.items()], "name STRING, n LONG")


def _bucketed(report: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    """A report over lines and orders in buckets of their order, which leave the catalog again."""

    def query(spark: SparkSession, root: str) -> DataFrame:
        t, tables = sample_tables(spark, root, numbered=True), []
        for name in ("order_products_prior", "orders"):
            tables.append(own_name(name))
            path = scratch_path(spark, name)
            t[name] = write_bucketed(t[name], tables[-1], path, "order_id", BUCKETS)
        result = report(t)
        for table in tables:
            spark.sql(f"DROP TABLE {table}")
        return result

    return query


def _published(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the second of two published sets."""
    # Both sets clean the same orders, so these are numbered once.
    orders = write_parquet(_raw_orders(spark, root), scratch_path(spark, "orders"))
    raw = {**sample_tables(spark, root), "orders": spark.read.parquet(orders)}
    shared, hot = scratch_path(spark, "shop"), _hot_users(spark, root)
    fewer = raw["order_products_prior"].where("order_id % 2 = 0")
    cleaning.preprocess({**raw, "order_products_prior": fewer}, shared, hot=hot, publish=True)
    cleaning.preprocess(raw, shared, hot=hot, publish=True)
    return load_tables(spark, shared, names=["order_products_prior"])["order_products_prior"]


def _parquet_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "prior")
    write_parquet(_lines(spark, root), path, cluster_key="order_id", partitions=16)
    return spark.read.parquet(path)


def _partition_pruning(spark: SparkSession, root: str) -> DataFrame:
    return reports.products_of_department(
        sample_tables(spark, root), scratch_path(spark, "products")
    )


def _file_view(spark: SparkSession, root: str) -> DataFrame:
    return sqltext.products_of_department(
        spark, sample_tables(spark, root), scratch_path(spark, "products")
    )


def _default_frame(spark: SparkSession, root: str) -> DataFrame:
    """Running lines per user along the order date, where orders of one date are peers."""
    t = sample_tables(spark, root)
    orders = mark_hot(t["orders"], "user_id", hot_keys(t["orders"], "user_id"))
    return running_totals(
        reports.sized_orders({**t, "orders": orders}, "user_id", "order_ts", "_hot"),
        key="user_id",
        order_by=["order_ts"],
        totals={"items_to_date": F.col("basket_size")},
        blocks=[F.to_date("order_ts")],
        peers=True,
    )


def _mine(spark: SparkSession, root: str) -> FPGrowthModel:
    items = reports.order_aisles(sample_tables(spark, root))
    path = scratch_path(spark, "mining")
    return itemsets.mine(items, MIN_SUPPORT, path, MIN_CONFIDENCE)


def _itemsets(spark: SparkSession, root: str) -> DataFrame:
    return itemsets.frequent_itemsets(_mine(spark, root)).withColumn(
        "items", F.array_join("items", ",")
    )


def _frequent_pairs(spark: SparkSession, root: str) -> DataFrame:
    return itemsets.frequent_pairs(_mine(spark, root))


def _rules(spark: SparkSession, root: str) -> DataFrame:
    return itemsets.rules(_mine(spark, root))


def queries() -> dict[str, Query]:
    return {**order_queries(), **_training_data()[0]}


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the subpackage and the pipeline that may be absent."""
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    subpackage = find_spec("trolley.llm")
    if subpackage is None or subpackage.origin is None:
        # Not there, or a folder without modules. The pipeline is built from its operators.
        return found, sql
    from trolley.llm.queries import FURTHER, ORACLES, QUERIES

    found.update(QUERIES | FURTHER)
    sql.update(ORACLES)
    if find_spec("corpus_pipeline"):
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def order_queries() -> dict[str, Query]:
    return {
        "q1_weekend_lunch_baskets": _over(reports.weekend_lunch_baskets, min_items=MIN_ITEMS),
        "q2_order_profile": _over(reports.order_profile, numbered=True),
        "q3_dept_dow_hour": _over(reports.department_hours),
        "q3_large": _over(reports.department_hours, max_bytes=0),
        "q4_top_products": _over(reports.top_products),
        "q4_exact_n": _over(reports.top_products_exact),
        "q5_running_basket": _running_basket,
        "q5_cut_users": _running_basket_cut,
        "q6_power_users": _over(reports.power_users),
        "q6_with_global_avg": lambda spark, root: reports.power_users_with_average(
            sample_tables(spark, root)
        ).withColumn("global_avg", F.round("global_avg", 9)),
        "q7_lines_per_aisle": _over(reports.lines_per_aisle),
        "q7_large": _over(reports.lines_per_aisle, max_bytes=0),
        "q8_dow_reorder_rate": _over(reports.reorder_rate_by_day),
        "q9_user_line_counts": _from_cache(
            reports.orders_with_line_counts, reports.user_line_counts, "user-counts"
        ),
        "rdd_q9_basket_sizes": _from_cache(
            lambda t: basket_sizes(t["order_products_prior"]), lambda kept: kept, "sizes"
        ),
        "q10_partition_pruning": _partition_pruning,
        "repartition_by_key": _over(reports.hashed_products_of_department),
        "sql_q1": _sql(sqltext.weekend_lunch_baskets, min_items=MIN_ITEMS),
        "sql_q2": _sql(sqltext.order_profile, numbered=True),
        "sql_q3": _sql(sqltext.department_hours),
        "sql_q3_large": _sql(sqltext.department_hours, max_bytes=0),
        "sql_q4": _sql(sqltext.top_products),
        "sql_q5": _sql_running_basket,
        "sql_q5_cut_users": _sql_running_basket_cut,
        "sql_q6": _sql(sqltext.power_users),
        "sql_q7": _sql(sqltext.lines_per_aisle),
        "sql_q7_large": _sql(sqltext.lines_per_aisle, max_bytes=0),
        "sql_q8": _sql(sqltext.reorder_rate_by_day),
        "sql_q9_cached_view": _sql_from_cache,
        "sql_q10_file_view": _file_view,
        "bench_filter_count": _over(reports.reordered_line_count),
        "bench_group_count_sum": _over(reports.product_totals),
        "bench_broadcast_join_count": _over(reports.aisle_lines),
        "bench_product_dow": _over(reports.product_days),
        "bench_product_dow_large": _over(reports.product_days, max_bytes=0),
        "etl_dedup_key": lambda spark, root: cleaning.dedup_by_key(
            _lines(spark, root), "order_id"
        ),
        "etl_dedup_rows": lambda spark, root: cleaning.dedup_rows(_lines(spark, root)),
        "etl_fill_nulls": lambda spark, root: cleaning.fill_first_gap(_raw_orders(spark, root)),
        "etl_order_ts": _order_time,
        "etl_order_ts_cut": _order_time_cut,
        "etl_wide": _etl_wide,
        "src_csv_typed": _csv_typed,
        "src_csv_products": _csv_products,
        "src_csv_lines": _csv_lines,
        "src_format_choice": _format_choice,
        "src_present_tables": _present_tables,
        "materialized_counts": _materialized,
        "src_csv_quarantine": lambda spark, root: _csv_with_bad_lines(spark, root)["orders"],
        "src_csv_rejected": lambda spark, root: _csv_with_bad_lines(spark, root)["orders_rejected"],
        "q1_bucketed": _bucketed(lambda t: reports.weekend_lunch_baskets(t, MIN_ITEMS)),
        "q5_bucketed": _bucketed(reports.running_basket),
        "q8_bucketed": _bucketed(reports.reorder_rate_by_day),
        "etl_published": _published,
        "sink_parquet_roundtrip": _parquet_roundtrip,
        "window_default_frame": _default_frame,
        "fp_frequent_pairs": _frequent_pairs,
        "fp_rules": _rules,
        "fp_itemsets": _itemsets,
    }


# The order tables in DuckDB SQL, from the given tables. Every oracle query starts with them.
ORDER_TABLES = """
WITH RECURSIVE departments AS (
    SELECT CAST(ROW_NUMBER() OVER (ORDER BY p_type) AS INT) AS department_id,
           p_type AS department
    FROM (SELECT DISTINCT p_type FROM part)
),
aisles AS (
    SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS aisle_id, p_brand AS aisle FROM part
),
products AS (
    SELECT p_partkey AS product_id, p_name AS product_name,
           CAST(substr(p_brand, 7) AS INT) AS aisle_id, department_id
    FROM part JOIN departments ON p_type = department
),
prior AS (
    SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS add_to_cart_order,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS reordered
    FROM lineitem
),
shop_orders AS (
    SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS eval_set,
           ROW_NUMBER() OVER in_order AS order_number,
           CAST((CAST(o_orderdate AS DATE) - DATE '1994-12-31') % 7 AS INT) AS order_dow,
           CAST(o_orderkey % 24 AS INT) AS order_hour_of_day,
           CAST(CAST(o_orderdate AS DATE) - CAST(LAG(o_orderdate) OVER in_order AS DATE)
                AS DOUBLE) AS days_since_prior_order,
           o_orderdate AS order_ts
    FROM orders
    WINDOW in_order AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
),
basket AS (
    SELECT order_id, COUNT(*) AS basket_size FROM prior GROUP BY order_id
),
sized AS (
    SELECT * FROM shop_orders JOIN basket USING (order_id)
),
described AS (
    SELECT * FROM prior
    JOIN products USING (product_id) JOIN aisles USING (aisle_id)
    JOIN departments USING (department_id)
)"""

RAW_ORDERS = ", ".join(RAW_ORDER_COLUMNS)

ORDER_TIME = """,
elapsed AS (
    SELECT *, SUM(COALESCE(days_since_prior_order, 0)) OVER (
        PARTITION BY user_id ORDER BY order_number) AS days
    FROM shop_orders
),
timed AS (
    SELECT order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day,
           COALESCE(days_since_prior_order, 0.0) AS days_since_prior_order,
           DATE '2017-01-01' + CAST(trunc(days) AS INT) AS order_date,
           CAST(DATE '2017-01-01' + CAST(trunc(days) AS INT) AS TIMESTAMP)
               + to_hours(order_hour_of_day) AS order_ts
    FROM elapsed
)"""

# Every subset of every basket, grown item by item; short baskets keep this feasible in DuckDB.
ITEMSETS = f""",
items AS (
    SELECT DISTINCT order_id, aisle AS item FROM described
),
subsets AS (
    SELECT order_id, item AS last_item, [item] AS items FROM items
    UNION ALL
    SELECT s.order_id, i.item, list_append(s.items, i.item)
    FROM subsets AS s JOIN items AS i ON i.order_id = s.order_id AND i.item > s.last_item
),
n AS (
    SELECT COUNT(DISTINCT order_id) AS baskets FROM items
),
frequent AS (
    SELECT items, COUNT(*) AS baskets FROM subsets GROUP BY items
    HAVING COUNT(*) >= CEIL({MIN_SUPPORT} * (SELECT baskets FROM n))
)"""


def oracle_sql() -> dict[str, str]:
    rate = "COUNT(*) AS line_items, AVG(reordered) AS reorder_rate"
    weekend_lunch = f"""
        SELECT order_id, user_id, order_dow, order_hour_of_day, basket_size, order_ts
        FROM sized
        WHERE order_dow IN (0, 1) AND order_hour_of_day BETWEEN 11 AND 14
          AND basket_size > {MIN_ITEMS}"""
    profile = """
        SELECT COUNT(*) AS total_orders, COUNT(DISTINCT user_id) AS unique_users,
               AVG(days_since_prior_order) AS avg_days_between,
               MIN(order_hour_of_day) AS earliest_hour, MAX(order_hour_of_day) AS latest_hour,
               COUNT(*) FILTER (WHERE order_dow IN (0, 1)) AS weekend_orders
        FROM shop_orders"""
    department_hours = f"""
        SELECT department, order_dow, order_hour_of_day, {rate}
        FROM described JOIN shop_orders USING (order_id)
        GROUP BY department, order_dow, order_hour_of_day"""
    top = """,
        reorders AS (
            SELECT department, product_id, product_name,
                   CAST(SUM(reordered) AS BIGINT) AS total_reorders
            FROM described GROUP BY department, product_id, product_name
        )
        SELECT *, CAST({place} AS INT) AS {name} FROM reorders QUALIFY {name} <= 5"""
    rank = "RANK() OVER (PARTITION BY department ORDER BY total_reorders DESC)"
    row_number = (
        "ROW_NUMBER() OVER (PARTITION BY department ORDER BY total_reorders DESC, product_id)"
    )
    running = """
        SELECT user_id, order_number, order_ts, basket_size,
               AVG(basket_size) OVER so_far AS running_avg_basket,
               CAST(SUM(basket_size) OVER so_far AS BIGINT) AS cumulative_items
        FROM sized
        WINDOW so_far AS (PARTITION BY user_id ORDER BY order_number
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    per_user = """,
        per_user AS (
            SELECT user_id, AVG(basket_size) AS user_avg_basket FROM sized GROUP BY user_id
        )"""
    above = "WHERE user_avg_basket > (SELECT AVG(user_avg_basket) FROM per_user)"
    power_users = f"{per_user} SELECT user_id, user_avg_basket FROM per_user {above}"
    per_aisle = "SELECT aisle, COUNT(*) AS line_items FROM described GROUP BY aisle"
    per_day = f"""
        SELECT order_dow, {rate} FROM prior JOIN shop_orders USING (order_id)
        GROUP BY order_dow"""
    per_user_lines = """
        SELECT user_id, COUNT(*) AS line_items FROM prior JOIN shop_orders USING (order_id)
        GROUP BY user_id"""
    product_days = f"""
        SELECT product_id, order_dow, {rate}
        FROM prior JOIN shop_orders USING (order_id) JOIN products USING (product_id)
        GROUP BY product_id, order_dow"""
    department_4 = "SELECT * FROM products WHERE department_id = 4"
    bodies = {
        "q1_weekend_lunch_baskets": weekend_lunch,
        "q2_order_profile": profile,
        "q3_dept_dow_hour": department_hours,
        "q3_large": department_hours,
        "sql_q3_large": department_hours,
        "q5_cut_users": running,
        "q1_bucketed": weekend_lunch,
        "q5_bucketed": running,
        "q8_bucketed": per_day,
        "sql_q5_cut_users": running,
        "q7_large": per_aisle,
        "sql_q7_large": per_aisle,
        "q4_top_products": top.format(place=rank, name="rank"),
        "q4_exact_n": top.format(place=row_number, name="rank"),
        "q5_running_basket": running,
        "q6_power_users": power_users,
        "q6_with_global_avg": f"""{per_user}
            SELECT user_id, user_avg_basket,
                   ROUND((SELECT AVG(user_avg_basket) FROM per_user), 9) AS global_avg
            FROM per_user {above}""",
        "q7_lines_per_aisle": per_aisle,
        "q8_dow_reorder_rate": per_day,
        "q9_user_line_counts": per_user_lines,
        "rdd_q9_basket_sizes": "SELECT * FROM basket",
        "q10_partition_pruning": department_4,
        "repartition_by_key": department_4,
        "sql_q1": weekend_lunch,
        "sql_q2": profile,
        "sql_q3": department_hours,
        "sql_q4": top.format(place=rank, name="rk"),
        "sql_q5": running,
        "sql_q6": power_users,
        "sql_q7": per_aisle,
        "sql_q8": per_day,
        "sql_q9_cached_view": per_user_lines,
        "sql_q10_file_view": department_4,
        "bench_filter_count": "SELECT COUNT(*) AS line_items FROM prior WHERE reordered = 1",
        "bench_group_count_sum": """
            SELECT product_id, COUNT(*) AS line_items,
                   CAST(SUM(reordered) AS BIGINT) AS reorders
            FROM prior GROUP BY product_id""",
        "bench_broadcast_join_count": per_aisle,
        "bench_product_dow": product_days,
        "etl_dedup_key": """
            SELECT * FROM prior QUALIFY ROW_NUMBER() OVER (
                PARTITION BY order_id ORDER BY product_id, add_to_cart_order, reordered) = 1""",
        "etl_dedup_rows": "SELECT DISTINCT * FROM prior",
        "etl_fill_nulls": f"""
            SELECT {", ".join(RAW_ORDER_COLUMNS[:-1])},
                   COALESCE(days_since_prior_order, 0.0) AS days_since_prior_order
            FROM shop_orders""",
        "etl_order_ts": f"{ORDER_TIME} SELECT * FROM timed",
        "etl_wide": f"""{ORDER_TIME}
            SELECT department_id, aisle_id, product_id, order_id, add_to_cart_order, reordered,
                   user_id, eval_set, order_number, order_dow, order_hour_of_day,
                   days_since_prior_order, order_date, order_ts, product_name, aisle, department
            FROM (SELECT DISTINCT * FROM prior)
            JOIN timed USING (order_id) JOIN products USING (product_id)
            JOIN aisles USING (aisle_id) JOIN departments USING (department_id)""",
        "bench_product_dow_large": product_days,
        "etl_order_ts_cut": f"{ORDER_TIME} SELECT * FROM timed",
        "src_csv_products": """
            SELECT product_id, aisle_id, department_id, CASE product_id % 6
                   WHEN 0 THEN '  ' || product_name || ' '
                   WHEN 1 THEN '"' || product_name || '", "x"'
                   WHEN 2 THEN ''
                   WHEN 3 THEN product_name || chr(10) || product_name
                   WHEN 4 THEN product_name END AS product_name
            FROM products""",
        "src_csv_lines": f"""
            SELECT order_id + {FAR} AS order_id, product_id + {FAR} AS product_id,
                   add_to_cart_order, reordered
            FROM prior""",
        "src_format_choice": """
            SELECT aisle_id, aisle, CASE aisle_id % 2 WHEN 0 THEN 'parquet' ELSE 'csv' END AS format
            FROM aisles""",
        "src_present_tables": """
            SELECT 'aisles' AS name, COUNT(*) AS n FROM aisles
            UNION ALL SELECT 'departments', COUNT(*) FROM departments
            UNION ALL SELECT 'products', COUNT(*) FROM products""",
        "materialized_counts": """
            SELECT 'aisles' AS name, COUNT(*) AS n FROM aisles
            UNION ALL SELECT 'departments', COUNT(*) FROM departments
            UNION ALL SELECT 'products', COUNT(*) FROM products
            UNION ALL SELECT 'orders', COUNT(*) FROM shop_orders
            UNION ALL SELECT 'order_products_prior', COUNT(*) FROM prior""",
        "src_csv_quarantine": f"""
            SELECT {RAW_ORDERS} FROM shop_orders WHERE order_id % {BAD_EVERY} <> 7""",
        "src_csv_rejected": f"""
            SELECT concat(order_id, ',', user_id, ',', eval_set, ',x', order_number, ',',
                          order_dow, ',', order_hour_of_day, ',',
                          COALESCE(CAST(days_since_prior_order AS VARCHAR), '')) AS line
            FROM shop_orders WHERE order_id % {BAD_EVERY} = 7""",
        "etl_published": "SELECT DISTINCT * FROM prior",
        "src_csv_typed": f"SELECT {RAW_ORDERS} FROM shop_orders",
        "sink_parquet_roundtrip": "SELECT * FROM prior",
        "window_default_frame": """
            SELECT order_id, user_id, order_ts, basket_size,
                   CAST(SUM(basket_size) OVER (PARTITION BY user_id ORDER BY order_ts)
                        AS BIGINT) AS items_to_date
            FROM sized""",
        "fp_frequent_pairs": f"""{ITEMSETS}
            SELECT items[1] AS item_a, items[2] AS item_b, baskets
            FROM frequent WHERE len(items) = 2""",
        "fp_itemsets": f"""{ITEMSETS}
            SELECT array_to_string(items, ',') AS items, baskets FROM frequent""",
        "fp_rules": f"""{ITEMSETS},
            split AS (
                SELECT items, baskets, UNNEST(items) AS consequent
                FROM frequent WHERE len(items) > 1
            ),
            counted AS (
                SELECT array_to_string(a.items, ',') AS antecedent, consequent,
                       s.baskets / a.baskets AS confidence,
                       c.baskets / (SELECT baskets FROM n) AS consequent_support,
                       s.baskets / (SELECT baskets FROM n) AS support
                FROM split AS s
                JOIN frequent AS a ON a.items = list_filter(s.items, lambda x: x <> consequent)
                JOIN frequent AS c ON c.items = [consequent]
            )
            SELECT antecedent, consequent, ROUND(confidence, 9) AS confidence,
                   ROUND(confidence / consequent_support, 9) AS lift,
                   ROUND(support, 9) AS support
            FROM counted WHERE confidence >= {MIN_CONFIDENCE}""",
    }
    ours = {name: f"{ORDER_TABLES} {body}" for name, body in bodies.items()}
    return {**ours, **_training_data()[1]}
