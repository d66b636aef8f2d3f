"""The steps of each run as a state machine on a stream: start, end, skip, stop, reset."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STEP = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("has_error", T.BooleanType()), T.StructField("skipped", T.BooleanType()),
    T.StructField("changed_at", T.LongType()),
])
# What is kept of a run, times in microseconds: one value, read and written in one call, as each call of a
# state leaves the Python worker.
_KEPT = T.StructType([
    T.StructField("step", T.IntegerType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()), T.StructField("runs", T.BooleanType()),
    T.StructField("failed", T.BooleanType()), T.StructField("stops", T.BooleanType()),
])
_RUN = T.StructType([
    T.StructField("reset_at", T.LongType()), T.StructField("last_at", T.LongType()),
    T.StructField("steps", T.ArrayType(_KEPT)),
])


def step_events(
    events: DataFrame, run: str, step: Column, ts: str, seq: str, status: Column, *,
    enabled: Column | None = None, failed: Column | None = None, stops: Column | None = None, resets: Column | None = None,
) -> DataFrame:
    """(stream) Rows as :func:`run_steps` takes them.

    ``status`` is what the event says of its step: running, completed or error. Step 0 runs always, others
    when ``enabled``. ``failed``: the step logged an error. ``stops``: an error of this step ends
    the run. ``resets``: the run was stopped or reset at this time; a row without a step is only
    that. A null condition is false, but ``enabled`` is true unless given.
    """
    def flag(given: Column | None, default: bool) -> Column:
        return F.lit(default) if given is None else F.coalesce(given, F.lit(False))

    number = step.cast("int")
    return events.select(
        F.col(run).alias("run_id"), number.alias("step"), F.col(ts).cast("timestamp").alias("ts"),
        F.col(seq).cast("long").alias("seq"), status.cast("string").alias("status"),
        ((number <= 0) | flag(enabled, True)).alias("runs"), flag(failed, False).alias("failed"),
        flag(stops, False).alias("stops"), flag(resets, False).alias("resets"),
    )


def newest(events: DataFrame) -> DataFrame:
    """(stream) Of each Arrow batch only the rows that can matter: the last of a step, the last reset of a run.

    A run that sends most of a batch's events sends few rows to the task that keeps its state.
    """
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["ts", "seq"], kind="stable", na_position="first")
            last = ~rows.duplicated(["run_id", "step"], keep="last")
            resets = rows[rows["resets"]]
            reset = resets.index[~resets.duplicated(["run_id"], keep="last")]
            yield rows[last | rows.index.isin(reset)]

    return events.mapInPandas(keep, events.schema)


def settle(steps: dict[int, tuple], reset_at: int | None) -> list[tuple]:
    """(step, status, has_error, skipped, changed_at) of each step of a run, by its last events.

    A step whose last event is not after the run's last reset is idle, as is one that does not run and one
    behind the first step whose error stops the run.
    """
    def alive(kept) -> bool:
        return reset_at is None or kept[0] > reset_at

    ends = [n for n, k in steps.items() if alive(k) and k[3] and k[2] == "error" and k[5]]
    end = min(ends, default=None)
    out = []
    for number in sorted(steps):
        kept = steps[number]
        reached = alive(kept) and (end is None or number <= end)
        status = kept[2] if reached and kept[3] else "idle"
        out.append((number, status, reached and kept[3] and kept[4], reached and not kept[3], kept[0]))
    return out


def overall(statuses: list[str]) -> str:
    """Status of a run from its steps."""
    return next((s for s in ("error", "running", "completed") if s in statuses), "idle")


class StepMachine(StatefulProcessor):
    """Keeps the last event of each step of a run and its last reset; the order of arrival does not matter."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows, timerValues):
        reset_at, last_at, before = self.run.get() or (None, None, [])
        new: dict[int, tuple] = {}
        for row in rows:
            at = row.at
            last_at = at if last_at is None else max(last_at, at)
            if row.resets:
                reset_at = at if reset_at is None else max(reset_at, at)
            if row.step is not None:
                event = (at, row.seq, row.status, row.runs, row.failed, row.stops)
                if row.step not in new or _later(event, new[row.step]):
                    new[row.step] = event
        steps = {k[0]: tuple(k[1:]) for k in before}
        for number, event in new.items():
            if number not in steps or _later(event, steps[number]):
                steps[number] = event
        self.run.update((reset_at, last_at, [(number, *event) for number, event in steps.items()]))
        settled = settle(steps, reset_at)
        status = overall([s[1] for s in settled])
        self._expire(last_at, status)
        shown = [Row(**dict(zip(_STEP.names, s))) for s in settled]
        yield Row(run_id=key[0], run_status=status, n_steps=len(shown), last_at=last_at, steps=shown)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.run.clear()
        return iter([])

    def _expire(self, last_at: int, status: str) -> None:
        """A finished run is forgotten when event time is ``ttl_ms`` past its last event."""
        if self.ttl_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if status in ("completed", "error"):
            self.handle.registerTimer(last_at // 1000 + self.ttl_ms)

    def close(self) -> None:
        pass


def _later(event: tuple, other: tuple) -> bool:
    """Whether an event replaces another of its step: by time, then number, then content."""
    return _order(event) >= _order(other)


def _order(event: tuple) -> tuple:
    return event[0], -1 if event[1] is None else event[1], event[2] or "", *map(bool, event[3:])


def run_steps(events: DataFrame, delay: str = "1 hour", ttl_seconds: int | None = None) -> DataFrame:
    """(stream) One row for each run that a batch changed: run_id, run_status, n_steps, last_at and its steps.

    ``steps`` is an array of step, status, has_error, skipped and changed_at by step number. ``events`` comes
    from :func:`step_events`. Rows without a run, a time, or both a step and a reset are ignored. Of
    events at the same time the greater ``seq`` counts; a step as old as a reset is reset. A step
    that completes with errors in its log is completed, with has_error.

    Finished runs are forgotten ``ttl_seconds`` of event time after their last event, if that is given: rows
    then must not come more than ``delay`` after later ones, older ones are dropped, and a
    forgotten run that is heard of again begins anew. All steps of a run are read when it changes.
    The sink should keep the newest row of a run, as :func:`.tables.update_table` does, in update mode
    and started under :func:`keyed_state`.
    """
    known = F.col("run_id").isNotNull() & F.col("ts").isNotNull() & (F.col("step").isNotNull() | F.col("resets"))
    rows = newest(events.where(known)).withColumn("at", F.unix_micros("ts"))
    if ttl_seconds is not None:
        rows = rows.withWatermark("ts", delay)
    schema = T.StructType([
        T.StructField("run_id", events.schema["run_id"].dataType), T.StructField("run_status", T.StringType()),
        T.StructField("n_steps", T.LongType()), T.StructField("last_at", T.LongType()),
        T.StructField("steps", T.ArrayType(_STEP)),
    ])
    runs = rows.groupBy("run_id").transformWithState(
        StepMachine(None if ttl_seconds is None else ttl_seconds * 1000), schema, "Update",
        "None" if ttl_seconds is None else "EventTime",
    )
    timed = F.transform("steps", lambda s: s.withField("changed_at", F.timestamp_micros(s["changed_at"])))
    return runs.withColumns({"last_at": F.timestamp_micros("last_at"), "steps": timed})


def exploded_steps(runs: DataFrame) -> DataFrame:
    """The steps of runs as rows."""
    return runs.select("run_id", F.inline("steps"))


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state where maps and timers are possible."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
