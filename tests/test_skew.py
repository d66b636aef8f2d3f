"""Hot keys: the long way gives the same rows as the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from dockledger.operators import hooks, logs, orders
from dockledger.operators.skew import (
    attach, collect_parts, hot_keys, is_small, lookup, positions, repeat_rows, tasks_for,
)

LIMIT = 50


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows has key 7, a third has no key, some rows are equal."""
    random.seed(5)
    data = []
    for i in range(900):
        key = 7 if i % 3 == 0 else (None if i % 3 == 1 else 8 + random.randrange(40))
        data.append((key, random.randrange(30), i, f"v{i % 11}"))
    data += [(7, 3, 10_000, "same")] * 60
    return spark.createDataFrame(data, "key int, day int, id int, value string").repartition(6)


def _sorted(df):
    return sorted(df.collect(), key=str)


def test_hot_keys_are_the_large_ones(spark, rows):
    hashes = {r["h"]: r["key"] for r in rows.select("key", F.xxhash64("key").alias("h")).distinct().collect()}
    assert {hashes[h] for h in hot_keys(rows, ["key"], LIMIT)} == {7, None}
    assert hot_keys(rows, ["key"]) == {}


def test_sampled_hot_keys(spark):
    many = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key")
    )
    expected = many.where("key = -1").select(F.xxhash64("key")).first()[0]
    found = hot_keys(many, ["key"], 20_000)
    assert list(found) == [expected] and 5 <= found[expected] <= 8


def test_positions_of_hot_keys(rows):
    unique = rows.where("id < 10000")
    plain = positions(unique, ["key"], ["day", "id"], "n", "total", limit=10**6)
    split = positions(unique, ["key"], ["day", "id"], "n", "total", limit=LIMIT)
    assert _sorted(plain) == _sorted(split)
    assert plain.dtypes == split.dtypes


def test_positions_with_equal_rows_are_complete(rows):
    got = positions(rows.where("key = 7"), ["key"], ["day", "id"], "n", limit=LIMIT)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 361))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_attach_of_hot_keys(rows, how):
    table = rows.where("key is null or key < 28").groupBy("key").agg(F.max("id").alias("last"))
    plain = attach(rows, table, ["key"], how, limit=10**6)
    salted = attach(rows, table, ["key"], how, limit=LIMIT)
    assert _sorted(plain) == _sorted(salted)
    assert plain.columns == salted.columns


def test_equal_rows_of_a_hot_key_are_spread(spark):
    copies = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("key"), F.lit("x").alias("v"))
    table = spark.createDataFrame([(1, "a")], "key int, name string")
    spread = attach(copies, F.broadcast(table), ["key"], limit=100)
    assert spread.count() == 4000
    assert spread.where("name = 'a'").count() == 4000


def test_lookup_small_and_large(rows):
    table = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    small = lookup(rows, table, ["key"])
    large = lookup(rows, table, ["key"], max_rows=3, limit=LIMIT)
    assert _sorted(small) == _sorted(large)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_lookup_of_repeated_keys(rows, how):
    table = rows.where("key < 28").select("key", "day")
    small = lookup(rows, table, ["key"], how)
    large = lookup(rows, table, ["key"], how, max_rows=3, limit=LIMIT)
    assert _sorted(small) == _sorted(large) and 0 < small.count() < rows.count()


def test_parts_keep_all_items(rows):
    numbered = positions(rows.where("id < 10000"), ["key"], ["day", "id"], "n")
    parts = collect_parts(numbered, ["key"], "n", ["id"], max_items=25)
    assert parts.agg(F.max(F.size("items"))).first()[0] == 25
    assert parts.where("key = 7").count() == 12
    back = parts.select("key", F.inline("items")).select("key", "n", "id")
    assert _sorted(back) == _sorted(numbered.select("key", "n", "id"))


def test_group_first_of_hot_keys(rows):
    unique = rows.where("id < 10000")
    plain = orders.group_first(unique, ["key"], ["day", "id"], ["value"], limit=10**6)
    split = orders.group_first(unique, ["key"], ["day", "id"], ["value"], limit=LIMIT)
    assert _sorted(plain.select("id", "group_value")) == _sorted(split.select("id", "group_value"))


def test_step_progress_of_hot_run(rows):
    unique = rows.where("id < 10000")
    plain = logs.step_progress(unique, "key", ["day", "id"])
    split = logs.step_progress(unique, "key", ["day", "id"], limit=LIMIT)
    assert _sorted(plain) == _sorted(split)


def test_group_step_never_sees_more_than_its_chunk(rows):
    def step(group):
        assert len(group) <= 40
        return group.assign(cube=group["day"] ** 3)[["id", "group_row", "group_part", "cube"]]

    out = hooks.per_group(
        rows.where("id < 10000"), ["key"], ["day", "id"], step,
        "id int, group_row long, group_part long, cube long", chunk_rows=40, limit=LIMIT,
    )
    assert out.count() == 900
    assert out.where("group_part <> floor((group_row - 1) / 40)").count() == 0


def test_a_group_is_one_call_however_large(spark):
    rows = spark.range(250_000).select(F.lit(1).alias("key"), "id")

    def total(group):
        return group.assign(n=len(group)).head(1)[["key", "n"]]

    assert hooks.per_group(rows, ["key"], ["id"], total, "key int, n long").collect() == [(1, 250_000)]


def test_small_tables_are_told_without_gathering_rows(spark):
    table = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("wide"))
    assert is_small(table) and not is_small(table, max_rows=999) and not is_small(table, max_bytes=1_000_000)


def test_tasks_follow_the_rows(spark):
    many = spark.range(1_100_000)
    assert [tasks_for(many), tasks_for(many, 10_000), tasks_for(spark.range(60_000)), tasks_for(spark.range(0))] == [5, 110, 2, 1]


def test_lookup_looks_for_hot_keys_where_it_is_told(rows):
    table = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    plan = [
        lookup(rows, table, ["key"], max_rows=3, limit=LIMIT, probed=probed)._jdf.queryExecution().toString()
        for probed in (None, rows.where("key > 7"))
    ]
    assert ["_salt" in p for p in plan] == [True, False]


def test_chunks_of_many_keys_are_spread(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1050).alias("n"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        parts = repeat_rows(df, "n", chunk=1000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sizes = [r["count"] for r in parts]
    assert sum(sizes) == 1_050_000 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_repeated_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 25), ("d", -4), (None, 7)], "k string, n long")
    got = repeat_rows(df, "n", chunk=7).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {"b": 1, "c": 25, None: 7}
    assert repeat_rows(df, "n").columns == ["k"]


def test_missing_copies_equal_except_all(spark):
    need = spark.range(30_000).select((F.col("id") % 2).alias("order"), F.lit(None).cast("int").alias("line"))
    have = spark.range(2_000).select(F.lit(1).cast("long").alias("order"), F.lit(None).cast("int").alias("line"))
    got = orders.missing_lines(need, have, ["order", "line"]).groupBy("order").count().collect()
    assert {r["order"]: r["count"] for r in got} == {0: 15_000, 1: 13_000}
