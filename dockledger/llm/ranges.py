"""Tables laid out in one global order, and what each of their partitions holds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.session import scratch_path, shared_folder

# Column that holds a row's partition; the name is not for the columns of a caller.
PART = "__part_of_layout"


def laid_out(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows sorted over all partitions, each with its partition's number.

    Range partitions are cut on every order column, so rows that share the first
    columns still spread over tasks. The checkpoint fixes the partition of each row:
    a task that runs again after an executor was lost finds the same rows.
    """
    shared_folder(rows.sparkSession)
    fixed = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    return fixed.withColumn(PART, F.spark_partition_id())


def saved(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: made once, whoever reads them."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces with about ``size`` bytes in a text column, and one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
