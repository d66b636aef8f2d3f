"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockledger.llm.ranges import saved

MAX_ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node that has an edge.

    ``edges`` has columns a and b. Each round links every node to the smallest of its
    neighbours, first through larger ones, then through smaller ones, until only stars are
    left; the number of rounds grows with the logarithm of the longest path. Only a count and a
    checksum come to the driver. The edges of a round are a table in the shared folder.
    """
    pair = F.array("a", "b")
    current = saved(
        edges.where("a <> b").select(F.array_max(pair).alias("u"), F.array_min(pair).alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select("v", "v").distinct()
            )
        before = state
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = saved(small.union(low.select("u", "m")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
