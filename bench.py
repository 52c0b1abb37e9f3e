"""Time the reports and print one JSON line.

The order tables are prepared once as Parquet and as CSV (timed as ``etl``), as a shop would
keep them; then each report runs into Spark's ``noop`` sink, which computes every row and
column, unlike ``count()``. After one warm-up run each, the median of three runs counts.

Settings: BENCH_SF_DIR (test tables), BENCH_CPUS, BENCH_TABLES (order tables that are already
prepared as Parquet, in place of BENCH_SF_DIR), BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.functions import cached, scratch_path
from trolley.operators import cleaning, itemsets
from trolley.operators.windows import hot_keys, mark_hot, running_totals
from trolley.plans import reports, sqltext
from trolley.sources import load_tables, sample_tables, write_bucketed, write_csv, write_parquet
from trolley.sources.readers import Tables
from trolley.sources.schemas import CSV_FILES, TABLE_COLUMNS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLES_DIR = os.environ.get("BENCH_TABLES")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
TABLES = [name for name in CSV_FILES if name != "order_products_train"]
# The numbers of shuffle partitions of the published runs.
PARTITIONS = (4, 16, 64, 200)
# Orders of a user above this take the way of hot users in the skewed copy.
SKEWED_MAX_ROWS = 10_000


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("trolley-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def typical(build: Callable[[], DataFrame]) -> float:
    run(build())
    return statistics.median(seconds(lambda: run(build())) for _ in range(RUNS))


def prepare(spark: SparkSession) -> str:
    sample = sample_tables(spark, SF_DIR, numbered=True)
    raw_columns = [column.split()[0] for column in TABLE_COLUMNS["orders"].split(", ")]
    raw = {**sample, "orders": sample["orders"].select(*raw_columns)}
    hot = hot_keys(sample_tables(spark, SF_DIR)["orders"], "user_id")
    root = scratch_path(spark, "bench")
    cleaning.preprocess(raw, root, hot=hot)
    return root


def write_raw_csv(spark: SparkSession, t: Tables) -> str:
    root = scratch_path(spark, "bench-csv")
    for name in TABLES:
        raw = t[name].drop("order_date", "order_ts") if name == "orders" else t[name]
        write_csv(raw, f"{root}/{CSV_FILES[name]}")
    return root


def skewed(spark: SparkSession, t: Tables) -> Tables:
    """A copy where one order, one product and one user hold a third of the rows each."""
    root = scratch_path(spark, "bench-skewed")
    third = F.pmod(F.xxhash64(*t["order_products_prior"].columns), F.lit(3))
    lines = t["order_products_prior"].withColumns(
        {
            "order_id": F.when(third == 0, F.lit(1)).otherwise(F.col("order_id")),
            "product_id": F.when(third == 1, F.lit(1)).otherwise(F.col("product_id")),
        }
    )
    lost = F.pmod(F.xxhash64("order_id"), F.lit(3)) == 0
    orders = t["orders"].withColumn("user_id", F.when(lost, F.lit(1)).otherwise(F.col("user_id")))
    write_parquet(lines, f"{root}/order_products_prior")
    write_parquet(orders, f"{root}/orders")
    return {**t, **load_tables(spark, root, names=["order_products_prior", "orders"])}


def default_frame(t: Tables) -> DataFrame:
    sized = reports.sized_orders(t, "user_id", "order_number")
    return running_totals(
        mark_hot(sized, "user_id", hot_keys(sized, "user_id")),
        key="user_id",
        order_by=["order_number"],
        totals={"items_to_date": F.col("basket_size")},
        blocks=[F.floor(F.col("order_number") / cleaning.NUMBERS_PER_BLOCK)],
        peers=True,
    )


def bucketed(spark: SparkSession, t: Tables) -> Tables:
    """Lines and orders in as many buckets of their order as shuffles have parts."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = {
        name: write_bucketed(t[name], f"bench_{name}", scratch_path(spark, name), "order_id", buckets)
        for name in ("order_products_prior", "orders")
    }
    return {**t, **made}


def pairs_and_rules(spark: SparkSession, t: Tables) -> DataFrame:
    model = itemsets.mine(reports.order_aisles(t), 0.022, scratch_path(spark, "bench-mining"), 0.148)
    run(itemsets.frequent_pairs(model))
    return itemsets.rules(model)


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    root = TABLES_DIR
    if root is None:
        prepare(spark)
        start = time.perf_counter()
        root = prepare(spark)
        times["etl"] = time.perf_counter() - start
    t = load_tables(spark, root, names=TABLES)

    partitioned = scratch_path(spark, "bench-products")
    reports.products_of_department(t, partitioned)
    frames = {
        "q1": lambda: reports.weekend_lunch_baskets(t),
        "q2": lambda: reports.order_profile(t),
        "q3": lambda: reports.department_hours(t),
        "q4": lambda: reports.top_products(t),
        "q4_exact_n": lambda: reports.top_products_exact(t),
        "q5": lambda: reports.running_basket(t),
        "q6": lambda: reports.power_users(t),
        "q6_with_global_avg": lambda: reports.power_users_with_average(t),
        "q7": lambda: reports.lines_per_aisle(t),
        "q8": lambda: reports.reorder_rate_by_day(t),
        "q9_uncached": lambda: reports.user_line_counts(reports.orders_with_line_counts(t)),
        "q10": lambda: spark.read.parquet(partitioned).where("department_id = 4"),
        "sql_q1": lambda: sqltext.weekend_lunch_baskets(spark, t),
        "sql_q2": lambda: sqltext.order_profile(spark, t),
        "sql_q3": lambda: sqltext.department_hours(spark, t),
        "sql_q4": lambda: sqltext.top_products(spark, t),
        "sql_q5": lambda: sqltext.running_basket(spark, t),
        "sql_q6": lambda: sqltext.power_users(spark, t),
        "sql_q7": lambda: sqltext.lines_per_aisle(spark, t),
        "sql_q8": lambda: sqltext.reorder_rate_by_day(spark, t),
        "filter_parquet": lambda: reports.reordered_line_count(t),
        "aggregate_parquet": lambda: reports.product_totals(t),
        "broadcast_join_parquet": lambda: reports.aisle_lines(t),
        "dedup_key": lambda: cleaning.dedup_by_key(t["orders"], "order_id"),
        "dedup_rows": lambda: cleaning.dedup_rows(t["order_products_prior"]),
        "order_time": lambda: cleaning.add_order_time(t["orders"].drop("order_date", "order_ts")),
        "default_frame": lambda: default_frame(t),
        "mining": lambda: pairs_and_rules(spark, t),
    }
    uneven = skewed(spark, t)
    frames |= {
        "skewed_q3": lambda: reports.department_hours(uneven),
        "skewed_q5": lambda: reports.running_basket(uneven, max_rows=SKEWED_MAX_ROWS),
        "skewed_q8": lambda: reports.reorder_rate_by_day(uneven),
        "skewed_order_time": lambda: cleaning.add_order_time(
            uneven["orders"].drop("order_date", "order_ts")
        ),
    }
    by_bucket = bucketed(spark, t)
    frames |= {
        "bucketed_q1": lambda: reports.weekend_lunch_baskets(by_bucket),
        "bucketed_q5": lambda: reports.running_basket(by_bucket),
        "bucketed_q8": lambda: reports.reorder_rate_by_day(by_bucket),
    }
    for name, build in frames.items():
        times[name] = typical(build)

    with cached(reports.orders_with_line_counts(t)) as kept:
        times["q9_cached"] = typical(lambda: reports.user_line_counts(kept))

    csv = load_tables(spark, write_raw_csv(spark, t), "csv", TABLES)
    times["filter_csv"] = typical(lambda: reports.reordered_line_count(csv))
    times["aggregate_csv"] = typical(lambda: reports.product_totals(csv))
    times["broadcast_join_csv"] = typical(lambda: reports.aisle_lines(csv))

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    for n in PARTITIONS:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        times[f"product_days_{n}_partitions"] = typical(lambda: reports.product_days(t))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)

    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over all reports",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": {name: round(value, 4) for name, value in times.items()},
                "sf": os.path.basename(os.path.normpath(TABLES_DIR or SF_DIR)),
            }
        )
    )


if __name__ == "__main__":
    main()
