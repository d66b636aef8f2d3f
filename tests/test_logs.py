"""Run logs and step states, in batch and as streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from dockledger import schemas
from dockledger.operators import inventory, logs
from dockledger.session import scratch_path
from dockledger.sources import sinks, tables
from dockledger.streaming import tables as streams

T0 = dt.datetime(2024, 10, 21, 14, 30)


@pytest.fixture(scope="module")
def entries():
    levels = ["INFO", "ERROR", "WARNING", "SUCCESS"]
    return [
        (f"run{i % 3}", i, levels[i % 4], f"Message {i} 100%" if i % 5 else "[OCR] 识别", T0 + dt.timedelta(seconds=i // 2))
        for i in range(60)
    ]


@pytest.fixture(scope="module")
def log(spark, entries):
    return spark.createDataFrame(entries, schemas.LOG)


@pytest.fixture(scope="module")
def folder(spark, entries):
    """The log as JSON files, as a stream source reads it."""
    path = scratch_path(spark, "log-source")
    df = spark.createDataFrame(entries, schemas.LOG)
    df.repartition(4).write.json(path)
    return path


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_and_counts(log):
    assert logs.search_logs(log, "ocr").count() == 12
    assert logs.search_logs(log, "").count() == 60
    counts = logs.log_counts(log, "100%")
    assert counts.agg(F.sum("total"), F.sum("matching")).first()[:] == (60, 48)


def test_stream_counts_equal_batch(spark, log, folder):
    path = scratch_path(spark, "counts")
    stream = tables.read_log_stream(spark, folder, maxFilesPerTrigger="1")
    streams.update_table(logs.log_counts(stream, "100%"), path, ["run_id", "level"], compact_every=2).awaitTermination()
    assert _rows(streams.read_updated(spark, path, ["run_id", "level"])) == _rows(logs.log_counts(log, "100%"))
    kept = [len(streams._folders(spark, path, kind)) for kind in ("compact", "data")]
    assert kept[0] <= 1 and kept[1] <= 1


def test_stream_append_equals_batch(spark, log, folder):
    path = scratch_path(spark, "append")
    stream = tables.read_log_stream(spark, folder, maxFilesPerTrigger="1")
    streams.append_table(logs.search_logs(stream, "message"), path).awaitTermination()
    assert _rows(streams.read_appended(spark, path)) == _rows(logs.search_logs(log, "message"))


def test_stream_resumes_with_new_files(spark, entries):
    source, path = scratch_path(spark, "grow"), scratch_path(spark, "grown")
    for part in (entries[:40], entries[40:]):
        spark.createDataFrame(part, schemas.LOG).write.mode("append").json(source)
        stream = tables.read_log_stream(spark, source)
        streams.update_table(logs.log_counts(stream), path, ["run_id", "level"]).awaitTermination()
    got = streams.read_updated(spark, path, ["run_id", "level"])
    assert _rows(got) == _rows(logs.log_counts(spark.createDataFrame(entries, schemas.LOG)))


def test_stream_with_window_and_watermark(spark, log, folder):
    def windowed(df):
        marked = df.withWatermark("ts", "10 seconds").withColumn("span", F.window("ts", "5 seconds"))
        return logs.log_counts(marked, keys=["span", "level"])

    path = scratch_path(spark, "windowed")
    streams.update_table(windowed(tables.read_log_stream(spark, folder)), path, ["span", "level"]).awaitTermination()
    assert _rows(streams.read_updated(spark, path, ["span", "level"])) == _rows(windowed(log))


def test_export_is_in_order(spark, log):
    path = scratch_path(spark, "export")
    sinks.write_log_text(log, path)
    lines = [r.value for r in spark.read.text(path).withColumn("f", F.input_file_name())
             .withColumn("i", F.monotonically_increasing_id()).orderBy("f", "i").collect()]
    assert len(lines) == 60
    assert lines[1] == "[2024-10-21 14:30:00.000] ERROR: Message 1 100%"
    assert lines == [r.value for r in sinks.log_text(log.orderBy("ts", "seq")).collect()]


def _steps(spark, rows):
    return spark.createDataFrame(
        [(r, s, st, T0 + dt.timedelta(seconds=n), n, "ERROR" if st == "error" else "INFO")
         for n, (r, s, st) in enumerate(rows)],
        "run_id string, step int, status string, ts timestamp, seq int, level string")


def test_states_resets_and_run_status(spark):
    events = _steps(spark, [
        ("a", 0, "running"), ("a", 0, "completed"), ("a", 1, "running"), ("a", 1, "error"),
        ("b", 0, "running"), ("b", 0, "completed"), ("c", 0, "running"), ("d", 0, "completed"),
    ])
    states = logs.latest_states(events)
    got = {(r.run_id, r.step): (r.status, r.errors) for r in states.collect()}
    assert got == {("a", 0): ("completed", 0), ("a", 1): ("error", 1), ("b", 0): ("completed", 0),
                   ("c", 0): ("running", 0), ("d", 0): ("completed", 0)}
    status = {r.run_id: r.run_status for r in logs.run_status(states).collect()}
    assert status == {"a": "error", "b": "completed", "c": "running", "d": "completed"}
    stop = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=3)), ("d", T0)], "run_id string, ts timestamp")
    reset = {(r.run_id, r.step): r.status for r in logs.reset_states(states, stop).collect()}
    assert reset[("a", 0)] == reset[("a", 1)] == "idle" and reset[("d", 0)] == "completed"


def test_step_outcomes(spark):
    rows = [  # run, step, enabled, failed
        ("a", 0, False, False), ("a", 1, True, True), ("a", 2, True, False),
        ("b", 0, True, True), ("b", 1, False, True), ("b", 2, True, True), ("b", 3, True, False),
    ]
    df = spark.createDataFrame(rows, "run string, step int, enabled boolean, failed boolean")
    got = logs.step_outcomes(df, "run", "step", F.col("enabled"), F.col("failed"), F.col("step") >= 2)
    assert {(r.run, r.step): (r.status, r.has_error, r.skipped) for r in got.collect()} == {
        ("a", 0): ("completed", False, False), ("a", 1): ("completed", True, False),
        ("a", 2): ("completed", False, False), ("b", 0): ("completed", True, False),
        ("b", 1): ("idle", False, True), ("b", 2): ("error", True, False),
        ("b", 3): ("idle", False, False)}


def test_progress_and_elapsed(spark, log):
    got = logs.step_progress(log.where("run_id = 'run0'"), "run_id", ["ts", "seq"]).orderBy("seq").collect()
    assert got[0].position == 1 and float(got[-1].progress) == 100.0 and float(got[9].progress) == 50.0
    assert {r.run_id: r.elapsed_ms for r in logs.run_elapsed(log).collect()} == {
        "run0": 28000, "run1": 29000, "run2": 28000}


def test_entries_and_results(spark):
    out = spark.createDataFrame(
        [("r", 1, T0, "stdout", None, "填报", " --password p x \n"), ("r", 2, T0, "close", 1, None, "end")],
        "run_id string, seq int, ts timestamp, channel string, exit_code int, label string, text string")
    got = logs.log_entries(out).orderBy("seq").collect()
    assert got[0].message.startswith("[填报] --password *** x") and got[1].level == "ERROR"
    runs = spark.createDataFrame(
        [("a", 0, "o", "warn", 5), ("b", 3, "o", "", 5), ("c", 1, "", "bad", 5), ("d", None, "", "", 5)],
        "run_id string, exit_code int, stdout string, stderr string, execution_ms long")
    assert [(r.success, r.error) for r in tables.script_results(runs).collect()] == [
        (True, None), (False, "exit code: 3"), (False, "bad"), (False, "exit code: null")]


def test_readiness(spark):
    rows = [("h1", "Node.js", "v18.2.0"), ("h1", "Python", "Python 3.6.9"), ("h1", "Java", 'version "17.0.1"'),
            ("h2", "Node.js", "v18.2.0"), ("h2", "Python", "Python 3.12.0")]
    graded = inventory.grade_runtimes(spark.createDataFrame(rows, "host string, name string, raw string"))
    report = inventory.runtime_report(graded, graded)
    got = {r.host: (r.critical_issues, r.warnings, r.all_ready, r.overall_status)
           for r in inventory.readiness(report).collect()}
    assert got == {"h1": (0, 1, True, "warning"), "h2": (1, 0, False, "error")}
    shown = {(r.host, r.name): (r.version, r.message) for r in report.collect()}
    assert shown[("h1", "Node.js")] == ("v18.2.0", "版本符合要求") and shown[("h2", "Java")] == (None, "检查失败")
    optional = inventory.runtime_report(graded, graded, (("Node.js", True), ("Python", True), ("Java", False)))
    assert {r.host: r.overall_status for r in inventory.readiness(optional).collect()}["h2"] == "success"


def test_files_forms_and_lists(spark):
    names = ["document1.txt", "spreadsheet.xlsx", "report.pdf", "data.json", "config.yml", "B.TXT"]
    files = spark.createDataFrame([("f", n, 10 * i) for i, n in enumerate(names)],
                                  "folder string, fileName string, size long")
    got = inventory.file_type_maps(files, ["folder"]).first()
    assert got.file_types == {".txt": 2, ".xlsx": 1, ".pdf": 1, ".json": 1, ".yml": 1}
    assert inventory.file_totals(files).first()[:] == (6, 150)
    assert inventory.file_type_maps(files, ["folder"], max_entries=2).count() == 3
    form = spark.createDataFrame([(1, {"用户名": "admin", "邮箱": "a", "部门": "b", "职位": "c"})],
                                 "id int, fields map<string,string>")
    assert {(r.n_fields, r.field) for r in inventory.form_fields(form, ["id"]).collect()} == {
        (4, "用户名"), (4, "邮箱"), (4, "部门"), (4, "职位")}
    fruit = spark.createDataFrame(
        [("k", i, v) for i, v in enumerate(["apple", "banana", "cherry", "date", "elderberry"])],
        "k string, i int, v string")
    report = inventory.value_report(fruit, ["k"], "v", ["i"]).first()
    assert report.processed_data == ["APPLE", "BANANA", "CHERRY", "DATE", "ELDERBERRY"]
    assert report.total_items == 5 and report.status == "completed"
    parts = inventory.value_report(fruit, ["k"], "v", ["i"], max_items=2).orderBy("part").collect()
    assert [p.processed_data for p in parts] == [["APPLE", "BANANA"], ["CHERRY", "DATE"], ["ELDERBERRY"]]


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([("单", None)], "a string, b string")
    assert df.select(sinks.json_text(F.struct("a", "b"))).first()[0] == '{"a":"单","b":null}'
    assert "\n" in df.select(sinks.json_text(F.struct("a", "b"), pretty=True)).first()[0]
    path = scratch_path(spark, "json")
    sinks.write_json(df, path)
    assert json.loads(spark.read.text(path).first()[0]) == {"a": "单", "b": None}
