"""Run logs and step states. Functions marked (stream) also take a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockledger.functions.text import (
    contains_ignoring_case, elapsed_ms, log_level, redact, step_prefix, strip,
)
from dockledger.operators.skew import attach, positions


def log_entries(output: DataFrame, *more: str) -> DataFrame:
    """(stream) Log rows from output chunks: level by channel, step prefix, redacted text.

    ``output`` has run_id, seq, ts, channel, exit_code, label, text. The producer's
    time is kept, as are columns named in ``more``.
    """
    return output.select(
        "run_id", "seq",
        log_level("channel", "exit_code").alias("level"),
        redact(step_prefix("label", strip("text"))).alias("message"),
        "ts",
        *more,
    )


def search_logs(logs: DataFrame, term: str, message: str = "message") -> DataFrame:
    """(stream) Entries whose message contains the term, ignoring case."""
    return logs.where(contains_ignoring_case(message, term))


def log_counts(
    logs: DataFrame, term: str = "", keys: Sequence[str] = ("run_id", "level"),
    message: str = "message",
) -> DataFrame:
    """(stream) Entries in all and entries that match the term, per key.

    A stream keeps one counter pair per key for as long as it runs. To bound that,
    put an event-time window into the keys and a watermark on the logs.
    """
    hit = contains_ignoring_case(message, term)
    return logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matching")
    )


def _waited(delay: str) -> Column:
    """Whether a row came more than ``delay`` after its own time; one without a receiver's time did not."""
    return F.coalesce(F.col("received") > F.col("ts") + F.expr(f"interval {delay}"), F.lit(False))


def windowed_counts(
    logs: DataFrame, term: str = "", span: str = "1 hour", delay: str = "1 hour",
    keys: Sequence[str] = ("run_id", "level"), message: str = "message",
) -> DataFrame:
    """(stream) Totals of each event-time window, final once the window is over, and late rows apart.

    ``logs`` has the producer's ts and the receiver's time, ``received``. A row received within ``delay`` of
    its ts counts in the window of its ts. Any other is late: it counts in the window of its receipt, in rows
    with ``late`` set, so no row is lost and no total that was given out changes. In append
    mode a window is given out and its state dropped when the watermark, ``delay`` behind the newest
    time seen, has passed its end. If rows come in the order of their receipt, and none
    claims a ts after it, what a stream gives out equals the same windows of a batch.
    """
    counted = F.when(_waited(delay), F.col("received")).otherwise(F.col("ts")).cast("timestamp")
    hit = contains_ignoring_case(message, term)
    return (
        logs.withColumns({"late": _waited(delay), "counted_at": counted})
        .withWatermark("counted_at", delay)
        .groupBy(F.window("counted_at", span), "late", *keys)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matching"))
        .select(F.col("window.start").alias("since"), F.col("window.end").alias("until"), "late", *keys, "total", "matching")
    )


def once(logs: DataFrame, keys: Sequence[str] = ("run_id", "seq"), within: str = "1 hour", at: str = "received") -> DataFrame:
    """(stream) Rows sent again with the same keys appear once.

    Copies of a row must come within ``within`` of each other by their receiver's time; keys are remembered
    that long. Which copy stays is open. In batch, copies are dropped however far apart.
    """
    if not logs.isStreaming:
        return logs.dropDuplicates(list(keys))
    return logs.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))


def append_logs(*logs: DataFrame) -> DataFrame:
    """(stream) All logs as one."""
    first, *rest = logs
    for other in rest:
        first = first.unionByName(other)
    return first


def step_progress(
    events: DataFrame, run: str, order: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Position of each event in its run, and that position as a percentage."""
    numbered = positions(events, [run], order, "position", "n_steps", limit)
    return numbered.withColumn("progress", F.col("position") * 100.0 / F.col("n_steps"))


def latest_states(
    events: DataFrame,
    keys: Sequence[str] = ("run_id", "step"),
    status: str = "status",
    order: Sequence[str] = ("ts", "seq"),
    is_error: Column | None = None,
) -> DataFrame:
    """(stream) Last status per key, when it was set, and how many errors were logged.

    A step can end 'completed' with errors in its log; the count shows it.
    """
    errors = F.col("level") == "ERROR" if is_error is None else is_error
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return events.groupBy(*keys).agg(
        F.max_by(status, at).alias("status"),
        F.max(order[0]).alias("changed_at"),
        F.count_if(errors).alias("errors"),
    )


def reset_states(
    states: DataFrame, resets: DataFrame, run: str = "run_id", at: str = "ts"
) -> DataFrame:
    """States with those before the last stop or reset of their run put back to idle."""
    last = resets.groupBy(run).agg(F.max(at).alias("_reset_at"))
    out = attach(states, last, [run], "left")
    return out.withColumn(
        "status",
        F.when(F.col("_reset_at") >= F.col("changed_at"), F.lit("idle")).otherwise(F.col("status")),
    ).drop("_reset_at")


def step_outcomes(
    attempts: DataFrame,
    run: str,
    step: str,
    enabled: Column,
    failed: Column,
    stops: Column,
    limit: int | None = None,
) -> DataFrame:
    """Status each step of a run ends with.

    Step 0 always runs, other steps when enabled. A failing step ends the run only
    if it is one that stops it; the failing step is the one marked. A failing step
    that does not stop the run still completes, with ``has_error`` set. Steps after
    the stop, and disabled ones, stay idle; the latter are logged as skipped.
    """
    runs = (F.col(step) == 0) | enabled
    breaks = runs & failed & stops
    ends = attempts.groupBy(run).agg(F.min(F.when(breaks, F.col(step))).alias("_end"))
    out = attach(attempts, ends, [run], "inner", limit)
    reached = F.col("_end").isNull() | (F.col(step) <= F.col("_end"))
    return out.withColumns(
        {
            "status": F.when(~runs | ~reached, F.lit("idle"))
            .when(F.coalesce(breaks, F.lit(False)), F.lit("error"))
            .otherwise(F.lit("completed")),
            "has_error": runs & reached & failed,
            "skipped": ~runs & reached,
        }
    ).drop("_end")


def run_status(states: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """Status of each run from its steps: error, running, completed, else idle."""
    def some(value: str) -> Column:
        return F.bool_or(F.col(status) == value)

    return states.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.when(some("error"), F.lit("error"))
        .when(some("running"), F.lit("running"))
        .when(some("completed"), F.lit("completed"))
        .otherwise(F.lit("idle"))
        .alias("run_status"),
    )


def run_elapsed(events: DataFrame, run: str = "run_id", at: str = "ts") -> DataFrame:
    """Milliseconds from the first to the last event of each run."""
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_events"),
        elapsed_ms(F.min(at), F.max(at)).alias("elapsed_ms"),
    )
