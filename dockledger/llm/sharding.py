"""Balanced contiguous shards from a running sum of sizes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.ranges import PART, fresh, laid_out, saved


def text_bytes(text: str = "text", overhead: int = 8):
    """UTF-8 bytes of a text (null: none) plus a fixed number for its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def assign_shards(
    rows: DataFrame, order: Sequence[str], size: str, shards: int,
    shard: str = "shard", slot: str = "slot",
) -> DataFrame:
    """Cut the rows, in ``order``, into contiguous shards of nearly equal total size.

    A row goes to the shard in which the middle of its size falls, on the line from 0
    to the total; a shard differs from its share by less than one row. ``slot`` counts
    a shard's rows from 0 without gaps, in ``order``.

    The rows are sorted once over all partitions. Only one total for each partition and
    one count for each (partition, shard) come to the driver; the prefix sums inside
    partitions run in the tasks, batch by batch. ``order`` should end in columns
    that tell rows apart; rows equal in all of them are in any order. A null or negative
    size counts 0; nulls in ``order`` come first. An empty table gives no rows, and
    columns called like the new ones are replaced.
    """
    rows = rows.drop(shard, slot)
    laid = laid_out(rows, order)
    (bytes_,) = fresh(laid.columns, "__size")
    known = laid.withColumn(bytes_, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long"))
    sums = dict(known.groupBy(PART).agg(F.sum(bytes_)).collect())
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + sums[part]
    whole = max(total, 1)

    def shard_of(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        # floor(middle * shards / total) in whole numbers, safe past 2**63
        share, rest = divmod(whole * 2, shards)
        twice = 2 * start + sizes
        if rest == 0:
            return np.minimum(twice // share, shards - 1)
        guess = np.minimum((twice.astype(np.float64) * (shards / (2 * whole))).astype(np.int64), shards - 1)
        cuts = np.array([-(-2 * whole * k // shards) for k in range(shards + 1)], dtype=np.int64)
        guess -= twice < cuts[guess]
        return guess + (twice >= cuts[np.minimum(guess + 1, shards)]) * (guess < shards - 1)

    def placed(batches, slots=None):
        at, seen = None, {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column(batch.schema.get_field_index(PART))[0].as_py()
            at = starts[part] if at is None else at
            sizes = batch.column(batch.schema.get_field_index(bytes_)).to_numpy()
            ends = at + np.cumsum(sizes)
            found = shard_of(ends - sizes, sizes)
            at = int(ends[-1])
            if slots is None:
                for k, n in zip(*np.unique(found, return_counts=True)):
                    seen[int(k)] = seen.get(int(k), 0) + int(n)
                continue
            where = np.empty(len(found), dtype=np.int64)
            for k in np.unique(found):
                mine = found == k
                first = seen.get(int(k), slots[(part, int(k))])
                where[mine] = first + np.arange(mine.sum())
                seen[int(k)] = first + int(mine.sum())
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in (PART, bytes_)]
            names = [n for n in batch.schema.names if n not in (PART, bytes_)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found.astype(np.int32)), pa.array(where)], names=[*names, shard, slot]
            )
        if slots is None and seen:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part] * len(seen), pa.int32()),
                 "shard": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())}
            )

    counts = known.select(PART, bytes_).mapInArrow(placed, "part int, shard int, n long").collect()
    slots, used = {}, {}
    for part, k, n in sorted(map(tuple, counts)):
        slots[(part, k)] = used.get(k, 0)
        used[k] = used.get(k, 0) + n
    out = T.StructType(
        [*rows.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())]
    )
    return known.mapInArrow(lambda batches: placed(batches, slots), out)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The shard and slot of each document, by doc_id, with its size and checksum.

    Texts stay where they are: only ids, sizes and checksums are sorted.
    """
    sized = docs.select(
        "doc_id", text_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    sized = saved(sized, "sizes")
    placed = assign_shards(sized, ["doc_id", "text_crc32", "size"], "size", shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, order: Sequence[str] = ("doc_id",)) -> None:
    """Write whole documents as one folder a shard, each in slot order."""
    (size,) = fresh(docs.columns, "__bytes")
    placed = assign_shards(docs.withColumn(size, text_bytes()), list(order), size, shards).drop(size)
    placed.write.partitionBy("shard").parquet(path)
