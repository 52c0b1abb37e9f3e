"""Sets of tables that readers see whole or not at all.

A set is written into a folder of its own. Only when all its tables are there does a line about
it join the list of published sets, by Spark's own commit, so a job that fails half-way leaves
readers with the set before. Old sets stay until their owner deletes them: readers may be in them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "number LONG, published_at TIMESTAMP, folder STRING"


def new_set(root: str) -> str:
    """A folder for the tables of a set that is yet to be published."""
    return f"{root}/sets/{uuid.uuid4().hex}"


def _published(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_LIST).parquet(f"{root}/published")


def published_set(spark: SparkSession, root: str) -> str | None:
    """The folder of the set published last under ``root``, if any was."""
    try:
        last = _published(spark, root).orderBy(
            F.desc("number"), F.desc("published_at"), "folder"
        ).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return last and f"{root}/{last.folder}"


def publish_set(spark: SparkSession, root: str, folder: str) -> None:
    """Let readers of ``root`` see the tables in ``folder``, which :func:`new_set` gave."""
    try:
        number = (_published(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        number = 1
    line = spark.range(1).select(
        F.lit(number).cast("long").alias("number"),
        F.current_timestamp().alias("published_at"),
        F.lit(folder.removeprefix(f"{root}/")).alias("folder"),
    )
    line.coalesce(1).write.mode("append").parquet(f"{root}/published")
