"""A saved table of texts with an index of what letters stand together, for finding a term without reading all."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.text import contains_ignoring_case

# Blocks whose bits share one bitmap, as Spark's bitmap functions cut them.
_BLOCKS = 32_768


def trigrams(text: Column) -> Column:
    """The three-character strings of a text in lower case, repeats included; null and short texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(.{3}))."), 1)


def write_indexed(df: DataFrame, path: str, text: str, order: Sequence[str], blocks: int) -> None:
    """Save rows in ``blocks`` blocks by ``order``, and for each trigram a bitmap of the blocks that hold it.

    A task sends each trigram once for a block, and bitmaps are made where the blocks of a trigram have come
    together, so what is shuffled is bounded by trigrams and blocks, not by text. Choose the number of blocks so that a block is
    a file worth reading: its bitmaps take an eighth of a byte a block for each trigram.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id())
    laid.write.partitionBy("_block").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    saved = rows.select(F.col("_block").cast("long") + 1, F.explode(F.array_distinct(trigrams(F.col(text))))).toDF("block", "gram")
    tasks = max(1, math.ceil(blocks / 64))
    together = saved.distinct().repartitionByRange(tasks, "gram")
    index = together.groupBy("gram", F.bitmap_bucket_number("block").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("block")).alias("blocks")
    )
    index.sortWithinPartitions("gram").write.parquet(f"{path}/index")


def blocks_with(spark: SparkSession, path: str, term: str) -> list[int] | None:
    """Numbers of the blocks that hold all trigrams of a term; None if the term has none, so any block may hold it.

    One bitmap of 4 KB for each 32,768 blocks comes to the driver.
    """
    grams = spark.range(1).select(F.array_distinct(trigrams(F.lit(term)))).first()[0]
    if not grams:
        return None
    hits = (
        spark.read.parquet(f"{path}/index").where(F.col("gram").isin(grams)).groupBy("bucket")
        .agg(F.bitmap_and_agg("blocks").alias("blocks"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == len(grams)).collect()
    )
    found = []
    for hit in hits:
        bits = np.unpackbits(np.frombuffer(bytes(hit["blocks"]), np.uint8), bitorder="little")
        found += (np.flatnonzero(bits) + (hit["bucket"] - 1) * _BLOCKS).tolist()
    return sorted(found)


def search_indexed(spark: SparkSession, path: str, text: str, term: str) -> DataFrame:
    """Rows whose text contains the term, ignoring case: the index names blocks, the text decides.

    Same rows as a search of the whole table. A term of under three characters reads every block.
    """
    rows = spark.read.parquet(f"{path}/rows")
    blocks = blocks_with(spark, path, term)
    if blocks is not None:
        rows = rows.where(F.col("_block").isin(blocks)) if blocks else rows.where(F.lit(False))
    return rows.where(contains_ignoring_case(text, term)).drop("_block")
