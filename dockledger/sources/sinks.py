"""Writers: versioned tables, JSON, log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.text import log_line


def json_text(value: Column, pretty: bool = False) -> Column:
    """JSON with null fields kept and non-ASCII characters as they are."""
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, null fields kept."""
    df.write.option("ignoreNullFields", False).mode("errorifexists").json(path)


def write_version(df: DataFrame, table: str, version: int) -> str:
    """Write a table next to its earlier versions and return the new path.

    The table may be computed from an earlier version: Spark reads lazily, so a
    write over the path being read would destroy its own input. Readers move to the
    returned path. No index column is added.
    """
    path = f"{table.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_bucketed(
    df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str
) -> DataFrame:
    """Save a table cut into buckets by its keys, sorted inside each, and return it.

    Documents and lines saved with the same keys and number of buckets are totalled,
    numbered and joined by those keys without a shuffle. Choose the number so that a
    bucket fits a task. Rows go to their bucket before the write, one file each.
    """
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys).sortBy(*keys)
        .option("path", path).mode("errorifexists").saveAsTable(name)
    )
    return df.sparkSession.table(name)


def read_version(spark: SparkSession, table: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{table.rstrip('/')}/version={version}")


def log_text(logs: DataFrame) -> DataFrame:
    """Export lines of all logs, in no order."""
    return logs.select(log_line("ts", "level", "message").alias("value"))


def write_log_text(logs: DataFrame, path: str) -> None:
    """Export all logs as text files.

    The sort is by range, so the files in name order are the log in (ts, seq) order
    and no task holds all of it.
    """
    ordered = logs.orderBy("ts", "seq")
    log_text(ordered).write.mode("errorifexists").text(path)
