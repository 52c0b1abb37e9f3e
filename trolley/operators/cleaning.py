"""Cleaning raw order tables, and the denormalized wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.functions.sizing import BROADCAST_BYTES, broadcast_if_small, fits_broadcast
from trolley.operators.windows import hot_keys, mark_hot, running_totals
from trolley.sources.publishing import new_set, publish_set
from trolley.sources.readers import Tables, load_tables
from trolley.sources.writers import write_parquet

# Fixed value: the day on which every user's first order is placed.
BASE_DATE = "2017-01-01"

# Order numbers of a hot user that share an outer block of the running sum.
NUMBERS_PER_BLOCK = 100_000


def dedup_by_key(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per ``key``: the smallest by ``order_by``, by default all other columns.

    The total order makes the survivor the same on every run. The ``= 1`` filter lets each map
    task keep one row per key before the shuffle, so a key with many copies stays cheap.
    """
    order_by = order_by or [c for c in df.columns if c != key]
    first = Window.partitionBy(key).orderBy(*order_by)
    return df.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def dedup_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; copies are merged in the map tasks first."""
    return df.dropDuplicates()


def fill_first_gap(orders: DataFrame) -> DataFrame:
    """A user's first order has no gap to an earlier one: NULL becomes 0 days."""
    return orders.fillna({"days_since_prior_order": 0.0})


def add_order_time(
    orders: DataFrame,
    base_date: str = BASE_DATE,
    hot: DataFrame | None = None,
    numbers_per_block: int = NUMBERS_PER_BLOCK,
) -> DataFrame:
    """Add ``order_date`` and ``order_ts`` from the gaps between a user's orders.

    The date is ``base_date`` plus the gaps up to and including the order (default RANGE
    frame, so orders with equal numbers share a date). The time is date plus hour as
    TIMESTAMP_NTZ, which no daylight-saving change can shift. ``hot`` lists the users with very
    many orders; by default it is found in the orders.
    """
    if hot is None:
        hot = hot_keys(orders, "user_id")
    elapsed = running_totals(
        mark_hot(orders, "user_id", hot),
        key="user_id",
        order_by=["order_number"],
        totals={"_days": F.coalesce(F.col("days_since_prior_order"), F.lit(0.0))},
        blocks=[F.floor(F.col("order_number") / numbers_per_block)],
        peers=True,
    )
    on = F.date_add(F.lit(base_date).cast("date"), F.col("_days").cast("int"))
    hours = F.make_dt_interval(F.lit(0), F.col("order_hour_of_day"))
    return (
        elapsed.withColumn("order_date", on)
        .withColumn("order_ts", F.col("order_date").cast("timestamp_ntz") + hours)
        .drop("_days")
    )


def clean_orders(orders: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per order, gaps filled, with date and time."""
    if hot is None:
        # Looked for before removing copies, which would cost a shuffle; too many is no harm.
        hot = hot_keys(orders, "user_id")
    return add_order_time(fill_first_gap(dedup_by_key(orders, "order_id")), hot=hot)


def clean_tables(raw: Tables, hot: DataFrame | None = None) -> Tables:
    """Cleaned DataFrames for whichever of the raw tables are given."""
    cleaned = dict(raw)
    if "orders" in raw:
        cleaned["orders"] = clean_orders(raw["orders"], hot)
    for name in ("order_products_prior", "order_products_train"):
        if name in raw:
            cleaned[name] = dedup_rows(raw[name])
    return cleaned


def wide_lines(t: Tables, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every prior line with its order, product, aisle and department; each key appears once.

    Row-level by nature: single lines meet their order, and their product with its aisle and
    department. Each of the three dimensions is measured by itself and broadcast if small.
    A large product table gets its aisles and departments first; then, as for the orders, it
    is a sort-merge join whose hot partitions adaptive execution splits.
    """
    aisles = broadcast_if_small(t["aisles"], max_bytes)
    departments = broadcast_if_small(t["departments"], max_bytes)
    lines = t["order_products_prior"]
    wide = lines.join(t["orders"], "order_id")
    if fits_broadcast(t["products"], max_bytes):
        wide = wide.join(F.broadcast(t["products"]), "product_id")
        wide = wide.join(aisles, "aisle_id").join(departments, "department_id")
    else:
        described = t["products"].join(aisles, "aisle_id").join(departments, "department_id")
        wide = wide.join(described, "product_id")
    keys = ["department_id", "aisle_id", "product_id", "order_id"]
    return wide.select(
        *keys,
        *[c for c in lines.columns if c not in keys],
        *[c for c in t["orders"].columns if c not in keys],
        *[c for c in t["products"].columns if c not in keys],
        *[c for c in t["aisles"].columns if c not in keys],
        *[c for c in t["departments"].columns if c not in keys],
    )


def write_clean(
    raw: Tables, root: str, partitions: int | None = None, hot: DataFrame | None = None
) -> str:
    """Clean ``raw`` and write one Parquet folder per table under ``root``.

    The lines are clustered by order, in ``partitions`` parts or, by default, as many as the
    session's shuffles have. Later groupings by order then find most of an order's lines in
    one map task and shrink them there.
    """
    clustered = {"order_products_prior": "order_id"}
    for name, df in clean_tables(raw, hot).items():
        write_parquet(df, f"{root}/{name}", clustered.get(name), partitions)
    return root


def write_wide(t: Tables, path: str, partitions: int | None = None) -> str:
    """Write the wide table, clustered by user."""
    return write_parquet(wide_lines(t), path, "user_id", partitions)


def preprocess(
    raw: Tables,
    root: str,
    partitions: int | None = None,
    hot: DataFrame | None = None,
    publish: bool = False,
) -> Tables:
    """The whole preparation: clean, write the tables, build the wide table from what was written.

    Returns the written tables plus ``wide``. Reading them back means that nothing is cleaned
    twice and that the wide join starts from small lineage. The tables under ``root`` are
    overwritten one by one; with ``publish`` they are written beside the old ones, which readers
    of ``root`` see until all new tables are there.
    """
    spark = next(iter(raw.values())).sparkSession
    folder = new_set(root) if publish else root
    write_clean(raw, folder, partitions, hot)
    tables = load_tables(spark, folder, names=raw)
    write_wide(tables, f"{folder}/wide", partitions)
    if publish:
        publish_set(spark, root, folder)
    return {**tables, "wide": spark.read.parquet(f"{folder}/wide")}
