"""The step machine, windows with an end, and chunks sent twice, as streams."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dockledger.operators import logs
from dockledger.session import scratch_path
from dockledger.streaming import steps as machine
from dockledger.streaming import tables as streams

T0 = dt.datetime(2024, 10, 21, 14, 30)
EVENTS = "run_id string, step int, ts timestamp, seq long, status string, enabled boolean, failed boolean, stops boolean, resets boolean"


def events(seed, n=600, runs=12):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        step = None if rng.random() < 0.04 else rng.randint(0, 6)
        out.append((
            f"run{rng.randrange(runs)}", step, T0 + dt.timedelta(seconds=i // 2, microseconds=rng.randrange(3)), i,
            rng.choice(["running", "completed", "completed", "error"]), rng.random() < 0.8, rng.random() < 0.3,
            rng.random() < 0.2, step is None or rng.random() < 0.02,
        ))
    out += [(None, 1, T0, 1, "running", True, False, False, False), ("run0", None, T0, 2, "running", True, False, False, False),
            ("run0", 3, None, 3, "error", True, False, True, False), out[5], ("lone", 0, T0, None, None, None, None, None, None)]
    return out


def expected(rows):
    """What the machine must hold after all rows, by run."""
    kept, resets = defaultdict(dict), {}
    for run, step, ts, seq, status, enabled, failed, stops, reset in rows:
        if run is None or ts is None or (step is None and not reset):
            continue
        kept[run]
        if reset:
            resets[run] = max(resets.get(run, ts), ts)
        if step is not None:
            event = (ts, -1 if seq is None else seq, status or "", step <= 0 or bool(enabled), bool(failed), bool(stops), status)
            kept[run][step] = max(kept[run].get(step, event), event)
    out = {}
    for run, found in kept.items():
        live = {s: k for s, k in found.items() if run not in resets or k[0] > resets[run]}
        end = min((s for s, k in live.items() if k[3] and k[6] == "error" and k[5]), default=None)
        shown = []
        for step in sorted(found):
            k = found[step]
            reached = step in live and (end is None or step <= end)
            shown.append((step, k[6] if reached and k[3] else "idle", reached and k[3] and k[4], reached and not k[3], k[0]))
        statuses = [s[1] for s in shown]
        overall = next((s for s in ("error", "running", "completed") if s in statuses), "idle")
        out[run] = overall, shown
    return out


def as_steps(df):
    return machine.step_events(
        df, "run_id", F.col("step"), "ts", "seq", F.col("status"), enabled=F.col("enabled"), failed=F.col("failed"),
        stops=F.col("stops"), resets=F.col("resets"),
    )


def run_machine(spark, source, path, **options):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    with machine.keyed_state(spark):
        query = streams.update_table(machine.run_steps(as_steps(stream), **options), path, ["run_id"], compact_every=3)
    query.awaitTermination()
    return query


def held(spark, path):
    got = {}
    for row in streams.read_updated(spark, path, ["run_id"]).collect():
        got[row["run_id"]] = row["run_status"], [
            (s["step"], s["status"], s["has_error"], s["skipped"], s["changed_at"]) for s in row["steps"]
        ]
        assert row["n_steps"] == len(row["steps"])
    return got


def write_parts(spark, rows, source, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], EVENTS).coalesce(1).write.mode("append").parquet(source)


def test_machine_equals_its_rules_in_any_number_of_batches(spark):
    rows = events(3)
    for parts in (1, 5):
        source, path = scratch_path(spark, "events"), scratch_path(spark, "runs")
        write_parts(spark, rows, source, parts)
        run_machine(spark, source, path)
        assert held(spark, path) == expected(rows)


def test_machine_goes_on_and_a_batch_may_run_again(spark):
    rows, source, path = events(4), scratch_path(spark, "events"), scratch_path(spark, "runs")
    half = len(rows) // 2
    write_parts(spark, rows[:half], source, 2)
    run_machine(spark, source, path)
    assert held(spark, path) == expected(rows[:half])
    write_parts(spark, rows[half:], source, 2)
    run_machine(spark, source, path)
    assert held(spark, path) == expected(rows)
    # Forget that the last batch was finished, as after a failure: it runs again, with the same result.
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/checkpoint/commits")
    files = commits.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(commits) if s.getPath().getName().isdigit()]
    last = max(names, key=lambda p: int(p.getName()))
    assert int(last.getName()) >= 3
    files.delete(last, False)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(commits, f".{last.getName()}.crc"), False)
    run_machine(spark, source, path)
    assert held(spark, path) == expected(rows)


def test_finished_runs_are_forgotten(spark):
    def row(run, seconds, status, step=0):
        return (run, step, T0 + dt.timedelta(seconds=seconds), seconds, status, True, False, True, False)

    source, path = scratch_path(spark, "events"), scratch_path(spark, "runs")
    batches = [
        [row("done", 0, "completed"), row("open", 0, "running")], [row("other", 5000, "running")],
        [row("other", 9000, "running", 1)], [row("open", 9001, "completed", 1), row("done", 9002, "running", 4)],
    ]
    for batch in batches:
        write_parts(spark, batch, source, 1)
        query = run_machine(spark, source, path, delay="10 seconds", ttl_seconds=60)
    assert query.lastProgress.stateOperators[0].numRowsTotal > 0
    got = held(spark, path)
    assert [s[:2] for s in got["open"][1]] == [(0, "running"), (1, "completed")]
    assert [s[:2] for s in got["done"][1]] == [(4, "running")]


def test_only_the_last_of_each_step_is_sent(spark):
    rows = events(7, 2000, 2)
    df = as_steps(spark.createDataFrame(rows, EVENTS).where("run_id is not null and ts is not null").coalesce(1))
    small = machine.newest(df)
    assert small.count() <= 2 * 9 + 3 and small.count() < df.count() / 50


LOGS = "run_id string, seq long, level string, message string, ts timestamp, received timestamp"


def log_rows(seed, n=500):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        received = T0 + dt.timedelta(seconds=20 * i)
        behind = rng.choice([0, 1, 30, 60, 61, 400, 5000])
        out.append((f"r{i % 3}", i, rng.choice(["INFO", "ERROR"]), f"Value {i % 7}", received - dt.timedelta(seconds=behind), received))
    return out


def test_windows_end_and_late_rows_are_counted_apart(spark):
    rows, source, path = log_rows(1), scratch_path(spark, "logs"), scratch_path(spark, "windows")
    sizes, emitted = [], 0
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i : i + 50], LOGS).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(LOGS).json(source)
        counts = logs.windowed_counts(stream, "value 3", "5 minutes", "60 seconds", ["level"])
        query = streams.append_table(counts, path)
        query.awaitTermination()
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
        assert query.lastProgress.stateOperators[0].numRowsDroppedByWatermark == 0
    batch = logs.windowed_counts(spark.createDataFrame(rows, LOGS), "value 3", "5 minutes", "60 seconds", ["level"])
    minute = dt.timedelta(seconds=60)
    mark = max(r[5] if r[5] - r[4] > minute else r[4] for r in rows) - minute
    final = batch.where(F.col("until") <= F.lit(mark))
    got = streams.read_appended(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, final.collect()))
    assert batch.agg(F.sum("total")).first()[0] == len(rows)
    late = sum((r[5] - r[4]).total_seconds() > 60 for r in rows)
    assert batch.where("late").agg(F.sum("total")).first()[0] == late
    # 500 rows make about 70 windows by level and lateness; only the open ones are kept.
    assert max(sizes) < batch.count() / 3 and sizes[-1] <= sizes[0] + 4


def test_chunks_sent_twice_appear_once(spark):
    rows = log_rows(2, 120)
    again = [(*r[:5], r[5] + dt.timedelta(minutes=3)) for r in rows[::4]]
    source, path = scratch_path(spark, "logs"), scratch_path(spark, "once")
    sent = sorted(rows + again, key=lambda r: r[5])
    for i in range(0, len(sent), 30):
        spark.createDataFrame(sent[i : i + 30], LOGS).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(LOGS).json(source)
        query = streams.append_table(logs.once(stream, within="10 minutes"), path)
        query.awaitTermination()
    got = streams.read_appended(spark, path).select("run_id", "seq", "level", "message", "ts").collect()
    assert sorted(map(tuple, got)) == sorted(r[:5] for r in rows)
    assert query.lastProgress.stateOperators[0].numRowsTotal < len(rows)
    assert logs.once(spark.createDataFrame(sent, LOGS)).count() == len(rows)


@pytest.mark.parametrize("statuses, want", [([], "idle"), (["idle", "completed"], "completed"), (["running", "completed"], "running"), (["error", "running"], "error")])
def test_overall_status(statuses, want):
    assert machine.overall(statuses) == want


def test_a_run_costs_one_read_and_one_write_of_state_however_many_steps(monkeypatch):
    calls = []

    class State:
        def __init__(self):
            self.value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

    made = machine.StepMachine(None)
    made.init(Handle())
    row = lambda step, at, status: machine.Row(
        step=step, at=at, seq=at, status=status, runs=True, failed=False, stops=False, resets=False
    )
    (first,) = made.handleInputRows(("r",), iter([row(k, k, "running") for k in range(100)]), None)
    (second,) = made.handleInputRows(("r",), iter([row(k, 200, "completed") for k in range(0, 100, 2)]), None)
    assert calls == ["get", "update"] * 2
    assert first.n_steps == second.n_steps == 100 and second.run_status == "running"
    assert [s.status for s in second.steps] == ["completed", "running"] * 50
