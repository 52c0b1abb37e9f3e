"""Tables bucketed by a key, whose groupings and joins on it need no shuffle.

Two tables with the same number of buckets on ``order_id`` are grouped by it and joined on it
where they are read: the shuffle is paid once, when they are written. A bucket is one task's
work, so a key with very many rows would be too; a table that has such keys is read as plain
files instead, which Spark splits and shuffles as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.operators.windows import HOT_ROWS, hot_keys, mark_hot
from trolley.sources.writers import salt

# Table properties that say how many keys are hot, and where the files are.
HOT_KEYS, FILES = "trolley.hot_keys", "trolley.files"


def write_bucketed(
    df: DataFrame, table: str, path: str, key: str, buckets: int, max_rows: int = HOT_ROWS
) -> DataFrame:
    """Overwrite ``table``, with its files under ``path``, in ``buckets`` sorted buckets.

    Rows are dealt by bucket first, so that each bucket is one file, and not one for each task;
    keys of more than ``max_rows`` rows are spread over all tasks, which then each write a part
    of the bucket. Returns the table as :func:`read_bucketed` does.
    """
    spark = df.sparkSession
    hot = hot_keys(df, key, max_rows)
    found = hot.count()
    dealt = df.repartition(buckets, key)
    if found:
        bucket = F.pmod(F.hash(key), F.lit(buckets))
        spread = F.when(F.col("_hot"), salt(df, buckets)).otherwise(-1)
        dealt = (
            mark_hot(df, key, hot)
            .withColumn("_spread", spread)
            .repartition(buckets, bucket, "_spread")
            .select(*df.columns)
        )
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    (
        dealt.write.format("parquet")
        .mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )
    quoted = path.replace("'", "\\'")
    spark.sql(
        f"ALTER TABLE {table} SET TBLPROPERTIES ('{HOT_KEYS}' = '{found}', '{FILES}' = '{quoted}')"
    )
    return read_bucketed(spark, table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The table by its buckets, or as plain files if it has hot keys."""
    about = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    if int(about.get(HOT_KEYS, 0)):
        return spark.read.schema(spark.table(table).schema).parquet(about[FILES])
    return spark.table(table)
