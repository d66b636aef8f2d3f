"""Streams to tables: append rows, or keep the newest row per key.

Each micro-batch is written to its own folder, named by its batch number. A batch
that runs again after a failure overwrites its own folder only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_table(rows: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Append the rows of a stream to parquet files at ``path``/data."""
    writer = rows.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{path}/checkpoint"
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(f"{path}/data")


def update_table(
    rows: DataFrame, path: str, keys: Sequence[str], available_now: bool = True, compact_every: int = 10
) -> StreamingQuery:
    """Write the changed rows of a streaming aggregate, batch by batch.

    After every ``compact_every`` batches the newest row of each key goes to a folder of its own, and the
    folders it replaces are removed: storage and reading follow the number of keys, not
    the time the stream has run. The folder is complete, marked by Spark's own success file, before
    anything is removed, and readers take the latest complete one.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        if (number + 1) % compact_every == 0:
            spark = batch.sparkSession
            read_updated(spark, path, keys).write.mode("overwrite").parquet(f"{path}/compact/batch={number}")
            _forget(spark, path, number)

    writer = rows.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{path}/checkpoint"
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _folders(spark: SparkSession, path: str, kind: str) -> dict[int, object]:
    """Complete batch folders below ``path``/``kind`` by number."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    files = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(parent):
        return {}
    found = {}
    for status in files.listStatus(parent):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("batch=") and files.exists(done):
            found[int(name.removeprefix("batch="))] = status.getPath()
    return found


def _forget(spark: SparkSession, path: str, last: int) -> None:
    """Remove what the compacted folder of batch ``last`` replaces."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, until in (("data", last), ("compact", last - 1)):
        for number, folder in _folders(spark, path, kind).items():
            if number <= until:
                files.delete(folder, True)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def read_updated(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a table written by :func:`update_table`."""
    compacted, data = _folders(spark, path, "compact"), _folders(spark, path, "data")
    last = max(compacted, default=-1)
    parts = [(last, compacted[last])] if compacted else []
    parts += [(number, folder) for number, folder in data.items() if number > last]
    rows = None
    for number, folder in parts:
        part = spark.read.parquet(folder.toString()).withColumn("_batch", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError(f"no complete batch at {path}")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in values])
