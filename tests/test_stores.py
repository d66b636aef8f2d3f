"""Versioned tables, digests, as-of joins, the search index, cut chunks, variants and batches of a group."""

import datetime as dt
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dockledger.functions import variants
from dockledger.functions.decode import decode_chunks
from dockledger.operators import asof, changes, hooks, search
from dockledger.session import scratch_path
from dockledger.sources.versions import StaleVersion, VersionedTable


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- versions ---------------------------------------------------------------

@pytest.fixture
def sheet(spark):
    df = spark.createDataFrame([(i, f"p{i % 4}" if i % 5 else None, "old") for i in range(40)], "id int, part string, info string")
    table = VersionedTable(spark, scratch_path(spark, "versions"), df.schema, ["part"])
    assert table.create(df) == 0
    return table, df


def changed(rows):
    return rows.withColumn("info", F.when(F.col("id") % 2 == 0, "new").otherwise(F.col("info")))


def test_a_change_rewrites_its_partition_only(spark, sheet):
    table, df = sheet
    before = table.manifest(0)
    where = df.where("part = 'p2'").select("part")
    assert table.update(changed, where) == 1
    after = table.manifest(1)
    assert {n for n in after if after[n] != before[n]} == {"part=p2"}
    assert all(size > 0 for entry in after.values() for size in entry["files"].values())
    got = {r["id"]: (r["part"], r["info"], r["version"]) for r in table.read().collect()}
    assert got == {
        r["id"]: (r["part"], "new" if r["part"] == "p2" and r["id"] % 2 == 0 else "old", int(r["part"] == "p2")) for r in df.collect()
    }
    assert rows_of(table.read(0).drop("version")) == rows_of(df)


def test_null_partitions_and_partitions_that_end(spark, sheet):
    table, df = sheet
    where = df.where("part is null or part = 'p1'").select("part")
    table.update(lambda rows: changed(rows).where("part is null"), where)
    got = table.read()
    assert got.where("part = 'p1'").count() == 0 and "part=p1" not in table.manifest(1)
    assert rows_of(got.where("part is null").select("id", "info")) == rows_of(changed(df.where("part is null")).select("id", "info"))
    assert table.update(changed, df.where("part = 'none'").select("part")) == 1


def test_rows_that_leave_their_partition_are_refused(spark, sheet):
    table, df = sheet
    held = rows_of(table.read())
    with pytest.raises(ValueError):
        table.update(lambda rows: rows.withColumn("part", F.lit("p3")), df.where("part = 'p1'").select("part"))
    assert table.version() == 0 and rows_of(table.read()) == held


def test_two_writers_of_one_version_one_fails_cleanly(spark, sheet):
    table, df = sheet
    other = VersionedTable(spark, table.path, table.schema, ["part"])
    table.update(changed, df.where("part = 'p1'").select("part"), base=0)
    held = rows_of(table.read())
    with pytest.raises(StaleVersion):
        other.update(lambda rows: rows.withColumn("info", F.lit("lost")), df.where("part = 'p2'").select("part"), base=0)
    assert rows_of(other.read()) == held and table.versions() == [0, 1]
    other.update(changed, df.where("part = 'p2'").select("part"))
    assert other.version() == 2


def test_the_rename_itself_refuses_a_stale_writer(spark, sheet, monkeypatch):
    table, df = sheet
    table.update(changed, df.where("part = 'p1'").select("part"))
    held = rows_of(table.read())
    other = VersionedTable(spark, table.path, table.schema, ["part"])
    monkeypatch.setattr(VersionedTable, "versions", lambda self: [0])
    with pytest.raises(StaleVersion):
        other.replace(df.where("part = 'p2'"), 0, ["part=p2"])
    monkeypatch.undo()
    assert table.versions() == [0, 1] and rows_of(table.read()) == held


def test_a_writer_that_dies_before_its_manifest_leaves_the_version_as_it_was(spark, sheet, monkeypatch):
    table, df = sheet
    held = rows_of(table.read())

    def dies(self, source, target):
        raise OSError("gone")

    monkeypatch.setattr(VersionedTable, "_rename", dies)
    with pytest.raises(OSError):
        table.update(changed, df.where("part = 'p1'").select("part"))
    monkeypatch.undo()
    assert table.version() == 0 and rows_of(table.read()) == held
    assert table.update(changed, df.where("part = 'p1'").select("part")) == 1


def test_no_version_and_no_rows(spark):
    table = VersionedTable(spark, scratch_path(spark, "none"), spark.createDataFrame([], "id int, part int").schema, ["part"])
    assert table.version() == -1
    with pytest.raises(ValueError):
        table.read()
    table.create(spark.createDataFrame([], table.schema))
    assert table.read().collect() == []


# --- digests ----------------------------------------------------------------

SCHEMA = "id long, a string, b double, l array<int>"


def saved(spark, rows, name):
    path = scratch_path(spark, name)
    changes.write_digested(spark.createDataFrame(rows, SCHEMA), path, ["id"], buckets=32, groups=4)
    return path


def test_changes_by_digest_equal_changes_by_join(spark):
    old = [(i, f"v{i % 7}" if i % 3 else None, i / 4, [i] if i % 2 else None) for i in range(500)]
    new = [r for r in old if r[0] not in (17, 20, 33)] + [(900, None, None, None)]
    new += [(20, None, 5.0, [20]), (33, old[33][1], None, old[33][3])]
    paths = saved(spark, old, "old"), saved(spark, new, "new")
    schema = spark.createDataFrame([], SCHEMA).schema
    want = changes.changed_rows(*[spark.createDataFrame(r, SCHEMA) for r in (old, new)], ["id"])
    got = changes.changed_saved_rows(spark, *paths, ["id"], schema)
    assert rows_of(got) == rows_of(want) and got.count() == 4
    found = changes.changed_buckets(spark, *paths)
    assert 1 <= len(found) <= 4
    for path in paths:
        read = spark.read.parquet(f"{path}/rows").where(F.col("_bucket").isin([b for _, b in found]))
        assert read.count() < 500 / 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan


def test_equal_tables_read_no_rows(spark):
    rows = [(i, "x", None, None) for i in range(100)]
    paths = saved(spark, rows, "one"), saved(spark, rows[::-1], "two")
    assert changes.changed_buckets(spark, *paths) == []
    assert changes.changed_saved_rows(spark, *paths, ["id"], spark.createDataFrame([], SCHEMA).schema).collect() == []
    empty = saved(spark, [], "empty")
    assert changes.changed_saved_rows(spark, empty, paths[0], ["id"], spark.createDataFrame([], SCHEMA).schema).count() == 100


def test_nulls_that_move_between_columns_change_the_digest(spark):
    schema = "id long, a string, b string"
    one = changes.row_digests(spark.createDataFrame([(1, None, "x")], schema), ["id"], 4, 2).first()
    two = changes.row_digests(spark.createDataFrame([(1, "x", None)], schema), ["id"], 4, 2).first()
    assert one["_first"] != two["_first"] and one["_second"] != two["_second"]


# --- as of ------------------------------------------------------------------

def day(n):
    return None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("setting", [{}, {"maxBroadcastRows": "2"}, {"maxBroadcastRows": "2", "maxGroupRows": "5"}])
def test_as_of_against_brute_force(spark, setting):
    rng = random.Random(11)
    ids = ["a", "a", "a", "b", "c", None, "none"]
    rows = [(i, rng.choice(ids), day(rng.choice([None, *range(60)]))) for i in range(300)]
    rows += rows[:5]
    periods = [(rng.choice(ids[:-1]), day(rng.choice([None, *range(60)])), rng.choice([None, 1, 2, 3])) for _ in range(80)]
    for name, value in setting.items():
        spark.conf.set(f"spark.dockledger.{name}", value)
    try:
        df = spark.createDataFrame(rows, "id int, s string, at date").repartition(3)
        table = spark.createDataFrame(periods, "s string, since date, grade int")
        got = rows_of(asof.as_of(df, table, ["s"], "at", "since", ["grade", "since"]))
    finally:
        for name in setting:
            spark.conf.unset(f"spark.dockledger.{name}")
    want = []
    for i, s, at in rows:
        past = [(p[1], p[2] is not None, p[2] or 0, p[2]) for p in periods if s is not None and at and p[0] == s and p[1] and p[1] <= at]
        best = max(past, default=None)
        want.append((i, s, at, best and best[3], best and best[0], best is not None))
    assert got == sorted(want, key=str)


def test_valid_on(spark):
    df = spark.createDataFrame([(1, "a", day(5)), (2, "a", day(9)), (3, "a", day(30)), (4, "b", day(1)), (5, "x", day(1))], "id int, s string, at date")
    periods = spark.createDataFrame(
        [("a", day(0), day(100), True), ("a", day(8), day(20), True), ("a", day(25), None, False), ("b", day(1), None, True)],
        "s string, since date, until date, ok boolean",
    )
    got = asof.valid_on(df, periods, ["s"], "at", "since", "until", F.col("ok"))
    assert {r["id"]: r["qualified"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert got.columns == ["id", "s", "at", "until", "qualified"]


# --- search index -----------------------------------------------------------

def test_indexed_search_equals_a_scan_and_reads_fewer_blocks(spark):
    rng = random.Random(5)
    texts = [None, "", "ab", "ABC", "100% of ÉTION", "x_y", "İstanbul", "𝄞𝄞a𝄞", "a\nb"] + [
        "".join(rng.choices("abcdefgh é", k=rng.randint(0, 40))) for _ in range(400)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    path = scratch_path(spark, "indexed")
    search.write_indexed(df, path, "t", ["id"], blocks=16)
    for term in ["", "a", "ab", "abc", "ABC", "100%", "étion", "_y", "istanbul", "İst", "𝄞a𝄞", "\nb", "zzz", "h é", "cab", "aaaa"]:
        want = rows_of(df.where(F.contains(F.lower("t"), F.lower(F.lit(term)))))
        assert rows_of(search.search_indexed(spark, path, "t", term)) == want, term
    assert search.blocks_with(spark, path, "ab") is None
    assert search.blocks_with(spark, path, "zzz") == []
    blocks = search.blocks_with(spark, path, "étion")
    assert len(blocks) == 1
    files = {re.search(r"_block=(\d+)", f).group(1) for f in search.search_indexed(spark, path, "t", "étion").inputFiles()}
    plan = search.search_indexed(spark, path, "t", "étion")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and str(blocks[0]) in files


def test_blocks_past_one_bitmap(spark):
    path = scratch_path(spark, "many")
    rows = spark.createDataFrame([(32_768, "abcd"), (70_000, "abce")], "block long, t string")
    rows.select(F.explode(search.trigrams(F.col("t"))).alias("gram"), (F.col("block") + 1).alias("block")).groupBy(
        "gram", F.bitmap_bucket_number("block").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("block")).alias("blocks")).write.parquet(f"{path}/index")
    assert search.blocks_with(spark, path, "ABC") == [32_768, 70_000]
    assert search.blocks_with(spark, path, "bce") == [70_000]


# --- cut chunks -------------------------------------------------------------

def cut(data, rng, sizes):
    out, at = [], 0
    while at < len(data):
        n = rng.choice(sizes)
        out.append(data[at : at + n])
        at += n
    return out or [b""]


@pytest.mark.parametrize("limit", [None, 8])
def test_any_cut_decodes_to_the_whole(spark, limit):
    rng = random.Random(6)
    chinese, mixed = "脚本输出中文识别完成一", "aé脚𝄞\n≤ x€"
    rows, want = [], {}
    for run in range(60):
        windows = run % 2 == 0
        text = "".join(rng.choices(chinese + ("a1\n" if run % 4 else ""), k=rng.randint(0, 40))) if windows else "".join(rng.choices(mixed, k=rng.randint(0, 40)))
        data = text.encode("gbk" if windows else "utf-8")
        if run in (3, 9):
            data, text = data + "脚".encode()[:2], text + "�"
        want[run] = text
        seq = 0
        for piece in cut(data, rng, [[1], [1, 2, 3], [0, 1, 5], [7, 64]][run % 3]):
            rows.append((run, seq, piece if rng.random() < 0.98 or piece else None, windows))
            seq += rng.randint(1, 3)
    rows.append((None, 0, b"alone", None))
    want[None] = "alone"
    df = spark.createDataFrame(rows, "run_id int, seq int, raw binary, windows boolean").repartition(5)
    got = decode_chunks(df, limit=limit)
    assert got.columns == ["run_id", "seq", "raw", "windows", "text"] and got.count() == len(rows)
    texts = {}
    for r in sorted(got.collect(), key=lambda r: (str(r["run_id"]), r["seq"])):
        texts[r["run_id"]] = texts.get(r["run_id"], "") + r["text"]
    assert texts == want


def test_bytes_that_are_no_utf8_decode_as_the_whole_does(spark):
    rng = random.Random(8)
    rows, whole = [], []
    for run in range(150):
        data = bytes(rng.choices([0x41, 0x80, 0xBF, 0xC2, 0xC0, 0xE2, 0x82, 0xAC, 0xF0, 0x9D, 0xF8, 0xFF], k=rng.randint(1, 14)))
        whole.append((run, data))
        rows += [(run, i, piece, False) for i, piece in enumerate(cut(data, rng, [1, 2, 3]))]
    got = decode_chunks(spark.createDataFrame(rows, "run_id int, seq int, raw binary, windows boolean"))
    joined = got.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "text"))).getField("text"), "").alias("t"))
    want = spark.createDataFrame(whole, "run_id int, raw binary").select("run_id", F.try_validate_utf8(F.lit("x")).alias("ok"), F.decode("raw", "UTF-8").alias("t"))
    assert rows_of(joined) == rows_of(want.select("run_id", "t"))


# --- variants ---------------------------------------------------------------

def test_fields_of_unsure_documents(spark):
    raw = [
        (1, '{"n": "x", "q": 1.5, "f": true, "l": [], "o": {}}'), (2, '{"n": null, "q": "1", "f": 0}'), (3, "{}"), (4, "[]"),
        (5, "not json"), (6, None), (7, '{"n": "y", "q": 12345678901234567890, "more": {"a": [1, null]}, "x\'y": null}'), (8, "null"),
    ]
    kinds = {"n": "text", "q": "number", "f": "flag", "l": "list", "o": "object"}
    df = variants.read_fields(spark.createDataFrame(raw, "id int, raw string"), "raw", kinds)
    assert df.columns == ["id", "raw", "n", "q", "f", "l", "o", "states", "unknown"]
    shown = {r["id"]: r for r in df.select("id", "n", F.col("q").cast("string").alias("q"), "f", "states", F.transform_values("unknown", lambda k, v: F.to_json(v)).alias("unknown")).collect()}
    assert shown[1]["states"] == {} and (shown[1]["n"], shown[1]["f"]) == ("x", True) and float(shown[1]["q"]) == 1.5
    assert shown[2]["states"] == {"n": "null", "q": "wrong type", "f": "wrong type", "l": "absent", "o": "absent"}
    assert shown[2]["n"] is None and shown[2]["q"] is None
    assert set(shown[3]["states"].values()) == {"absent"} and shown[3]["unknown"] == {}
    for i in (4, 5, 6, 8):
        assert shown[i]["states"] is None and shown[i]["unknown"] is None and shown[i]["n"] is None
    assert shown[7]["unknown"] == {"more": '{"a":[1,null]}', "x'y": "null"}
    assert shown[7]["q"].split(".")[0] == "12345678901234567890"
    plan = df.where("n = 'x' and q > 1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json") <= 1 or plan.count("parse_json") <= 2


# --- batches of a group -----------------------------------------------------

@settings(max_examples=5, deadline=None)
@given(st.integers(1, 40))
def test_a_group_comes_in_order_in_many_batches(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        rows = [(k, i) for k, n in (("hot", 300), ("cold", 7), (None, 5)) for i in range(n)]
        random.Random(size).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, i int").repartition(4)

        def seen(batches):
            n, held, key, largest = 0, True, None, 0
            for batch in batches:
                for k, i in zip(batch.column("k").to_pylist(), batch.column("i").to_pylist()):
                    held, key, n = held and i == n, k, n + 1
                largest = max(largest, batch.num_rows)
            yield pa.RecordBatch.from_pydict({"k": pa.array([key], pa.string()), "n": pa.array([n], pa.int32()), "ok": pa.array([held]), "largest": pa.array([largest], pa.int32())})

        got = hooks.per_group_batches(df, ["k"], ["i"], seen, "k string, n int, ok boolean, largest int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["k"]), r["n"], r["ok"]) for r in got) == [("None", 5, True), ("cold", 7, True), ("hot", 300, True)]
    assert max(r["largest"] for r in got) <= max(size, 1)


def test_trigrams_of_odd_texts_without_a_function_for_each_character(spark):
    texts = ["abcd", "a\nb\r\n", "x𝒳y𝒴z", "éÉ ÀÇ", "aa", "", None, "脚本输出"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    grams = df.select("id", search.trigrams(F.col("t")).alias("grams"))
    low = [(t or "").lower() for t in texts]
    assert dict(grams.collect()) == {i: [t[k : k + 3] for k in range(len(t) - 2)] for i, t in enumerate(low)}
    assert "lambda" not in grams._jdf.queryExecution().toString()
