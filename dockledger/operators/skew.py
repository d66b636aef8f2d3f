"""Grouping and joining when one key holds a large part of all rows.

Aggregates that combine map-side (sum, count, min_by, max_by) need none of this.
Two shapes do: numbering rows inside a group, and joining rows to the single row
of their group. Both first look for hot keys in a sample of the key columns. With
none, the plain Spark operator is used. With some, only the rows of those keys
take the longer way; the result is the same either way, because the sample picks
the strategy and never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.session import scratch_path, shared_folder

# Rows of one key that a single task may sort or join on its own; a session may set
# spark.dockledger.maxGroupRows.
MAX_GROUP_ROWS = 5_000_000
# Rows and bytes a table may have to be broadcast; spark.dockledger.maxBroadcastRows and
# spark.dockledger.maxBroadcastBytes.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
# Fewest tasks that share the rows of a hot key in a join.
SALTS = 8
# Rows that one task of a stage with many sorts should get; spark.dockledger.maxTaskRows. Below
# the second number a task is not worth its start.
MAX_TASK_ROWS = 250_000
MIN_TASK_ROWS = 50_000


def _setting(df: DataFrame, name: str, given: int | None, default: int) -> int:
    if given is not None:
        return given
    return int(df.sparkSession.conf.get(f"spark.dockledger.{name}", str(default)))


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> dict[int, int]:
    """Hashes of the keys that hold more than about ``limit`` rows, and about how many limits each.

    Reads the key columns only and shuffles about 200 sampled rows per ``limit``
    input rows. A key of ``limit`` rows is expected 200 times in the sample and
    is reported from 100 on. There are at most rows / ``limit`` of them.
    """
    limit = _setting(df, "maxGroupRows", limit, MAX_GROUP_ROWS)
    fraction = min(1.0, 200.0 / limit)
    rows = df.select(F.xxhash64(*keys).alias("key"))
    if fraction < 1.0:
        rows = rows.sample(fraction=fraction, seed=11)
        floor = 100
    else:
        floor = limit
    found = rows.groupBy("key").count().where(F.col("count") > floor).collect()
    return {row["key"]: math.ceil(row["count"] / fraction / limit) for row in found}


def tasks_for(df: DataFrame, limit: int | None = None) -> int:
    """In how many tasks the rows lie if none gets many more than ``limit``.

    For ``repartition`` before a stage that sorts its rows several times. Without a number, adaptive execution
    merges partitions by their compressed bytes, and 64 MB may be three million narrow rows, held once
    for each sort. A given number is never merged. Small tables get the session's partitions at most.
    """
    limit = _setting(df, "maxTaskRows", limit, MAX_TASK_ROWS)
    rows = df.count()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / limit), min(partitions, math.ceil(rows / MIN_TASK_ROWS)))


def _is_hot(keys: Sequence[str], hot: Collection[int]) -> Column:
    return F.xxhash64(*keys).isin(list(hot))


def _salts(keys: Sequence[str], hot: Mapping[int, int]) -> Column:
    """Parts of each key: a power of two, about two for each limit of rows it holds; one if not hot."""
    by_number: dict[int, list[int]] = {}
    for key, times in hot.items():
        by_number.setdefault(1 << max(SALTS, 2 * times).bit_length(), []).append(key)
    out = F.lit(1)
    for number, members in by_number.items():
        out = F.when(_is_hot(keys, members), F.lit(number)).otherwise(out)
    return out


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    position: str = "position",
    total: str | None = None,
    limit: int | None = None,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 in ``order``; optionally add the group size.

    Keys over ``limit`` rows are sorted across tasks: range partitions cut on keys
    and order, a number inside each (key, partition), plus the sizes of the key's
    earlier partitions.
    """
    hot = hot_keys(df, keys, limit) if hot is None else hot
    if not hot:
        return _positions_by_window(df, keys, order, position, total)
    cold = _positions_by_window(df.where(~_is_hot(keys, hot)), keys, order, position, total)
    return cold.unionByName(
        _positions_by_range(df.where(_is_hot(keys, hot)), keys, order, position, total)
    )


def _positions_by_window(df, keys, order, position, total):
    group = Window.partitionBy(*keys)
    out = df.withColumn(position, F.row_number().over(group.orderBy(*order)).cast("long"))
    if total:
        out = out.withColumn(total, F.count(F.lit(1)).over(group))
    return out


def _positions_by_range(df, keys, order, position, total):
    shared_folder(df.sparkSession)
    # The checkpoint fixes which partition each row is in; the partition number
    # is read twice below and must not change when a lost task is run again.
    laid = (
        df.repartitionByRange(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    inside = laid.withColumn(
        "_inside", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    )
    by_part = Window.partitionBy(*keys).orderBy("_part")
    sizes = (
        laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_size").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
    )
    right = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"), "_before", "_total",
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
        F.col("_part") == F.col("_p"),
    )
    added = [(F.col("_inside") + F.col("_before")).alias(position)]
    if total:
        added.append(F.col("_total").alias(total))
    return inside.join(right, same).select(*df.columns, *added)


def ranged_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None, part: str = "_range"
) -> tuple[DataFrame, bool]:
    """Rows with the range of their group that they lie in, and whether any group has more than one.

    Range 0 is a whole group. The rows of a hot key are cut into ranges from 1 on, in ``order``; rows
    equal in keys and order share a range. What a row needs of earlier rows then comes from a window over keys and
    range, and one row for each range carries what the ranges before it end with.
    """
    hot = hot_keys(df, keys, limit)
    if not hot:
        return df.withColumn(part, F.lit(0)), False
    # The table fixes the range of each row; its number is read more than once.
    path = scratch_path(df.sparkSession, "ranges")
    ranges = df.where(_is_hot(keys, hot)).repartitionByRange(*keys, *order)
    ranges.withColumn(part, F.spark_partition_id() + 1).write.parquet(path)
    laid = df.sparkSession.read.parquet(path)
    return df.where(~_is_hot(keys, hot)).withColumn(part, F.lit(0)).unionByName(laid), True


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join to one row for each of the few ranges of hot groups; null keys meet null keys."""
    named = groups.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys]
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int | None = None,
    hot: Mapping[int, int] | None = None,
) -> DataFrame:
    """Join rows to a table that has at most one row per key.

    The rows of a hot key are spread over as many tasks as its size asks for, and the
    table row of that key is repeated so often; all other keys keep one copy. The salt hashes the
    row with its partition number, so equal rows are spread too and a task that
    runs again gives its rows the same salts. ``how`` may be any join that keeps
    or drops whole left rows: inner, left, left_semi, left_anti.
    """
    keys = list(keys)
    hot = hot_keys(rows, keys, limit) if hot is None else hot
    if not hot:
        return rows.join(table, keys, how)
    plain = [
        f.name for f in rows.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    ]
    salts = _salts(keys, hot)
    salt = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), salts).cast("int")
    salted = rows.withColumn("_salt", salt)
    copies = F.sequence(F.lit(0), salts - 1)
    return salted.join(
        table.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how
    ).drop("_salt")


def is_small(table: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Whether a table may be broadcast, by the rows and bytes of each of its partitions.

    One number pair for each partition comes to the driver; no rows are gathered to be counted.
    """
    max_rows = _setting(table, "maxBroadcastRows", max_rows, MAX_BROADCAST_ROWS)
    max_bytes = _setting(table, "maxBroadcastBytes", max_bytes, MAX_BROADCAST_BYTES)

    def width(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
        return F.lit(16)

    total = reduce(lambda a, b: a + b, [width(f) for f in table.schema.fields], F.lit(0)).cast("long")
    parts = table.select(total.alias("_bytes"), F.spark_partition_id().alias("_part")).groupBy("_part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes")
    ).collect()
    return sum(p["n"] for p in parts) <= max_rows and sum(p["bytes"] for p in parts) <= max_bytes


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int | None = None,
    limit: int | None = None,
    counted: DataFrame | None = None,
    probed: DataFrame | None = None,
) -> DataFrame:
    """:func:`attach` that broadcasts the table after finding that it is small.

    ``counted`` is the table to measure instead: one with at least as many rows that
    needs no work to read. ``probed`` are likewise the rows to look for hot keys in. A semi or
    anti join takes a table with repeated keys.
    """
    only_keys = how in ("left_semi", "left_anti")
    if only_keys:
        table = table.select(*keys)
    if is_small(table if counted is None else counted, max_rows):
        return rows.join(F.broadcast(table), list(keys), how)
    hot = None if probed is None else hot_keys(probed, keys, limit)
    return attach(rows, table.distinct() if only_keys else table, keys, how, limit, hot)


def repeat_rows(df: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``times`` times (a column, which is dropped; rows below 1 go).

    A row repeated more than ``chunk`` times is first cut into chunks that are spread
    over tasks, so that neither an array nor one task grows with the number.
    """
    count = F.col(times)
    keys = [c for c in df.columns if c != times]
    # A fixed number of partitions: by their size in bytes, AQE would merge chunks
    # that are small now and large once written out.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = df.where(count.between(1, chunk))
    many = (
        df.where(count > chunk)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((count - 1) / chunk))))
        .withColumn(times, F.least(count - F.col("_chunk") * chunk, F.lit(chunk)))
        .repartition(partitions, *keys, "_chunk")
        .drop("_chunk")
    )
    out = few.unionByName(many)
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(
        "_n", times
    )


def collect_parts(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    fields: Sequence[str],
    items: str = "items",
    max_items: int | None = None,
) -> DataFrame:
    """Rows to arrays, one for each key.

    ``position`` numbers the rows of a key from 1. A caller whose keys may have more rows than
    one array should hold asks for parts: with ``max_items``, every key gives rows
    numbered by ``part`` from 0 with at most so many items each. The result asks to be
    merged, never broadcast, in a join: size estimates do not see inside arrays.
    """
    entry = F.struct(position, *[f for f in fields if f != position])
    if max_items is not None:
        df = df.withColumn("part", F.floor((F.col(position) - 1) / max_items).cast("long"))
        keys = [*keys, "part"]
    return (
        df.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias(items))
        .hint("merge")
    )
