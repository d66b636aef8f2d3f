"""What changed between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLACE = T.StructType([T.StructField("_group", T.IntegerType()), T.StructField("_bucket", T.IntegerType())])
# What a digest of rows is made of; none depends on the rows' order.
_DIGEST = ("n", "mixed", "total")
_DIGEST_SCHEMA = "n long, mixed long, total decimal(38,0), _group int"


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to submit: ``change`` is insert, update or delete.

    Both sides have unique, non-null keys and the same columns. A deleted row shows
    its old values, the others their new ones. One full join on the keys, without
    their order in the select mattering to the comparison: null equals null.
    """
    others = [c for c in new.columns if c not in keys]
    left = old.select(*keys, F.struct(*others).alias("_old"))
    right = new.select(*keys, F.struct(*others).alias("_new"))
    same = reduce(
        lambda a, b: a & b,
        [F.col("_old")[c].eqNullSafe(F.col("_new")[c]) for c in others],
    )
    change = (
        F.when(F.col("_old").isNull(), F.lit("insert"))
        .when(F.col("_new").isNull(), F.lit("delete"))
        .when(~same, F.lit("update"))
    )
    kept = F.coalesce("_new", "_old")
    return (
        left.join(right, list(keys), "full")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*keys, "change", *[kept[c].alias(c) for c in others])
    )


def row_digests(df: DataFrame, keys: Sequence[str], buckets: int, groups: int) -> DataFrame:
    """Rows with their bucket by key, the group of that bucket, and two hashes of all columns.

    Which columns are null goes into the hashes, as a hash of columns skips nulls. Maps and variants
    have no hash and raise an error.
    """
    columns = sorted(df.columns)
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    return df.withColumns({
        "_bucket": bucket, "_group": F.pmod(bucket, F.lit(groups)).cast("int"),
        "_first": F.xxhash64(*columns, nulls), "_second": F.xxhash64(nulls, *reversed(columns)),
    })


def _summed(df: DataFrame, keys: Sequence[str], n, mixed, total) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(n).alias("n"), F.bit_xor(mixed).alias("mixed"), F.sum(total).cast("decimal(38,0)").alias("total"))


def write_digested(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 4096, groups: int = 64) -> None:
    """Save a table by bucket of its keys, with digests of each bucket and of each group of buckets.

    A digest is the number of rows, the exclusive or of one hash and the sum of another: equal bags of
    rows have equal ones; that different ones do is as likely as two hashes of 64 bits agreeing by chance.
    """
    rows = row_digests(df, keys, buckets, groups)
    placed = rows.drop("_first", "_second").hint("rebalance", F.col("_bucket"))
    placed.write.partitionBy("_group", "_bucket").parquet(f"{path}/rows")
    spark = df.sparkSession
    saved = row_digests(spark.read.schema(df.schema).parquet(f"{path}/rows"), keys, buckets, groups)
    fine = _summed(saved, ["_group", "_bucket"], F.lit(1), "_first", F.col("_second").cast("decimal(20,0)"))
    fine.coalesce(1 + buckets // 1_000_000).write.partitionBy("_group").parquet(f"{path}/buckets")
    _summed(_buckets(spark, path), ["_group"], "n", "mixed", "total").coalesce(1).write.parquet(f"{path}/groups")


def _buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"_bucket int, {_DIGEST_SCHEMA}").parquet(f"{path}/buckets")


def _different(old: DataFrame, new: DataFrame, key: str) -> list[int]:
    """Keys whose digests differ, or that one side lacks."""
    both = old.select(key, F.struct(*_DIGEST).alias("_old")).join(new.select(key, F.struct(*_DIGEST).alias("_new")), key, "full")
    return sorted(r[0] for r in both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key).collect())


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[tuple[int, int]]:
    """(group, bucket) of the buckets that differ between two tables saved by :func:`write_digested`.

    Groups are compared first, and buckets only in groups that differ. The lists that come to the
    driver are at most as long as the numbers of groups and buckets chosen at the write.
    """
    groups = _different(*[spark.read.schema(_DIGEST_SCHEMA).parquet(f"{p}/groups") for p in (old, new)], "_group")
    if not groups:
        return []
    parts = [_buckets(spark, p).where(F.col("_group").isin(groups)) for p in (old, new)]
    found = _different(*[p.withColumn("_key", F.col("_bucket")) for p in parts], "_key")
    member = {r["_bucket"]: r["_group"] for p in parts for r in p.where(F.col("_bucket").isin(found)).select("_group", "_bucket").collect()}
    return sorted((member[b], b) for b in found)


def changed_saved_rows(spark: SparkSession, old: str, new: str, keys: Sequence[str], schema) -> DataFrame:
    """:func:`changed_rows` of two saved tables, reading only the buckets whose digests differ."""
    found = changed_buckets(spark, old, new)
    groups, buckets = sorted({g for g, _ in found}), [b for _, b in found]

    def side(path: str) -> DataFrame:
        saved = spark.read.schema(T.StructType([*schema.fields, *_PLACE.fields])).parquet(f"{path}/rows")
        rows = saved.where(F.col("_group").isin(groups) & F.col("_bucket").isin(buckets))
        return rows.select(*[f.name for f in schema.fields])

    if not found:
        empty = spark.createDataFrame([], schema)
        return changed_rows(empty, empty, keys)
    return changed_rows(side(old), side(new), keys)
