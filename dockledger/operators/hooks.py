"""Places for the caller's own code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.operators.documents import broken_rules
from dockledger.operators.skew import positions


def clean_documents(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame] | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """The caller's cleaning step: DataFrame code, or pandas code when a schema is given."""
    return df.transform(fn) if schema is None else df.mapInPandas(fn, schema)


def custom_rules(df: DataFrame, rules: Sequence[tuple[str, str | Column]]) -> DataFrame:
    """Names of the caller's rules that each row breaks."""
    return broken_rules(df, rules)


def per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    chunk_rows: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Call pandas code once per group, in row order.

    Each row carries its position in the group (``group_row``) and the size of the group
    (``group_rows``). One call holds a whole group, as the code asks for. Only a caller
    that can work on pieces gives ``chunk_rows``: then a group comes in calls of at
    most so many rows, and ``group_part`` is the number of the call.
    """
    numbered = positions(df, keys, order, "group_row", "group_rows", limit)
    if chunk_rows is not None:
        numbered = numbered.withColumn(
            "group_part", F.floor((F.col("group_row") - 1) / chunk_rows).cast("long")
        )
        keys = [*keys, "group_part"]

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        return fn(rows.sort_values("group_row", ignore_index=True))

    return numbered.groupBy(*keys).applyInPandas(call, schema)


def per_group_batches(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """Call the caller's code once per group with its rows in order, as Arrow batches one after the other.

    For groups that do not fit in memory: a task holds one batch, and what ``fn`` keeps. Rows come in
    ``order``, nulls first; a group's batches are as large as the session's Arrow batches. The
    rows of a group are still read by one task, sorted on disk, as one call asks for all of them.
    """
    laid = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return laid.groupBy(*keys).applyInArrow(_batches(fn), schema)


def _batches(fn):
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)

    return call
