"""Readers for the order tables, from raw CSV or from cleaned Parquet."""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.sources.publishing import published_set
from trolley.sources.schemas import CSV_FILES, table_schema

Tables = dict[str, DataFrame]


# No field of a CSV file is this string. With any null value but the empty string, Spark reads
# a blank field as NULL and a quoted empty one as an empty string.
NO_FIELD = "\0"


def read_csv_table(
    spark: SparkSession,
    path: str,
    name: str,
    narrow_ids: bool = False,
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """One headed CSV file with its explicit schema; nothing is inferred, so nothing is pre-read.

    ``multi_line`` allows line breaks in quoted fields; a file is then read by one task.
    """
    return (
        spark.read.options(header=True, mode=mode, multiLine=multi_line, nullValue=NO_FIELD)
        .options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .schema(table_schema(name, narrow_ids))
        .csv(path)
    )


def split_csv_table(
    spark: SparkSession,
    path: str,
    name: str,
    into: str,
    narrow_ids: bool = False,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows of a CSV file, and the lines that are not, in column ``line``.

    A line is malformed if a field is not of its type or their number differs. The file is
    parsed once, into Parquet files under ``into``, which both results read: counting the lines
    does not parse it again, and a reader never sees a row with only some of its fields.
    """
    schema = table_schema(name, narrow_ids).add("line", "string").add("malformed", "boolean")
    parsed = (
        spark.read.options(header=True, mode="PERMISSIVE", multiLine=multi_line)
        .options(nullValue=NO_FIELD, columnNameOfCorruptRecord="line")
        .options(escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .schema(table_schema(name, narrow_ids).add("line", "string"))
        .csv(path)
    )
    marked = parsed.withColumn("malformed", F.col("line").isNotNull())
    marked.write.mode("overwrite").partitionBy("malformed").parquet(into)
    stored = spark.read.schema(schema).parquet(into)
    return (
        stored.where(~F.col("malformed")).drop("line", "malformed"),
        stored.where("malformed").select("line"),
    )


def load_tables(
    spark: SparkSession,
    root: str,
    format: str = "parquet",
    names: Iterable[str] = tuple(CSV_FILES),
    optional: Collection[str] = (),
    narrow_ids: bool = False,
    mode: str = "FAILFAST",
    multi_line: bool = False,
    quarantine: str | None = None,
) -> Tables:
    """The named tables under ``root``, keyed by table name.

    Where sets of tables have been published under ``root``, it stands for the last of them.

    The format is the caller's choice and is never switched silently: raw CSV lacks the
    columns that cleaning adds. A table that is not there raises, unless it is ``optional``.
    For CSV, ids and order numbers are bigint unless ``narrow_ids`` asks for int, and ``mode``
    says what becomes of a malformed field: an error (FAILFAST), NULL (PERMISSIVE) or the row
    dropped (DROPMALFORMED). With ``quarantine``, a folder, lines with malformed fields are
    kept apart instead: as ``<name>_rejected``, with one column ``line``. ``multi_line`` is for
    names with line breaks.
    """
    if format not in ("csv", "parquet"):
        raise ValueError(f"format must be 'csv' or 'parquet', not {format!r}")
    if format == "parquet":
        root = published_set(spark, root) or root
    tables: Tables = {}
    for name in names:
        try:
            if format == "csv":
                path = f"{root}/{CSV_FILES[name]}"
                if quarantine is not None:
                    tables[name], tables[f"{name}_rejected"] = split_csv_table(
                        spark, path, name, f"{quarantine}/{name}", narrow_ids, multi_line
                    )
                    continue
                tables[name] = read_csv_table(
                    spark, path, name, narrow_ids, mode, multi_line
                )
            else:
                tables[name] = spark.read.parquet(f"{root}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND" and name in optional:
                continue
            raise
    return tables
