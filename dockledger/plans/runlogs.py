"""Run logs on the driver tables: a user is a run, an event a log entry or a step change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.functions.decode import decode_output as decoded
from dockledger.functions.decode import encode_gbk
from dockledger.functions.text import log_line, percent_text, redact, step_prefix, usage_band
from dockledger.operators import logs
from dockledger.plans.registry import REGISTRY, query, table
from dockledger.session import scratch_path
from dockledger.sources import tables
from dockledger.streaming import steps as machine
from dockledger.streaming import tables as streams

TERM = "Value=1"

_LOG_SQL = """logs as (
      select user_id as run_id, event_id as seq, ts, case event_type
          when 'view' then 'INFO' when 'click' then 'INFO' when 'error' then 'ERROR'
          when 'signup' then 'WARNING'
          else case when value < 100 then 'SUCCESS' else 'ERROR' end end as level,
        concat(case when event_type = 'view' then '' else concat('[', event_type, '] ') end,
          'value=', cast(floor(value) as bigint), ' --password ***',
          substr(props, strpos(props, ' '))) as message
      from events)"""


def _output(events: DataFrame, *more: str) -> DataFrame:
    """Output chunks of the scripts, from events, with ``more`` of their columns."""
    kind = F.col("event_type")
    channel = (
        F.when(kind.isin("view", "click"), "stdout").when(kind == "error", "stderr")
        .when(kind == "signup", "kill").otherwise("close")
    )
    text = F.concat(
        F.lit(" value="), F.floor("value").cast("string"), F.lit(" --password "),
        F.col("props"), F.lit(" "),
    )
    return events.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("seq"),
        "ts",
        channel.alias("channel"),
        F.when(kind == "purchase", F.when(F.col("value") < 100, 0).otherwise(1))
        .alias("exit_code"),
        F.when(kind != "view", kind).alias("label"),
        text.alias("text"),
        *more,
    )


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_entries(_output(table(spark, folder, "events")))


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return tables.read_log_stream(
        spark, folder, schema, "parquet", pathGlobFilter="events.parquet"
    )


@query("F17 F18 V7 T1", f"with {_LOG_SQL} select run_id, seq, level, message from logs")
def log_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _logs(spark, folder).select("run_id", "seq", "level", "message")


@query(
    "S9 F18",
    f"""with {_LOG_SQL}
    select concat('[', strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), '] ', level, ': ', message) as line
    from logs""",
)
def log_export(spark: SparkSession, folder: str) -> DataFrame:
    return _logs(spark, folder).select(log_line("ts", "level", "message").alias("line"))


@query(
    "F16 A6",
    f"""with {_LOG_SQL}
    select run_id, level, count(*) as total,
      count(*) filter (where contains(lower(message), lower('{TERM}'))) as matching
    from logs group by 1, 2""",
)
def log_counts(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_counts(_logs(spark, folder), TERM)


@query(
    "F16",
    """select doc_id, lang, n_chars from documents where contains(lower(text), lower('ÉTION'))""",
)
def log_search(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts searched for a term, ignoring case."""
    return logs.search_logs(table(spark, folder, "documents"), "ÉTION", "text").select(
        "doc_id", "lang", "n_chars"
    )


@query("F16", "select doc_id, lang, n_chars from documents where contains(lower(text), '%')")
def log_search_literal(spark: SparkSession, folder: str) -> DataFrame:
    """A percent sign in the term is just that character."""
    return logs.search_logs(table(spark, folder, "documents"), "%", "text").select(
        "doc_id", "lang", "n_chars"
    )


@query(
    "A6 F16",
    """select role as level, count(*) as total,
      count(*) filter (where contains(lower(text), lower('The'))) as matching
    from conversations group by 1""",
)
def conversation_counts(spark: SparkSession, folder: str) -> DataFrame:
    return logs.log_counts(
        table(spark, folder, "conversations").withColumnRenamed("role", "level"),
        "The", ["level"], "text",
    )


@query(
    "V7",
    r"""select doc_id, regexp_replace(regexp_replace(text, '(--password[\s=]+)\S+', '\1***', 'g'),
      '((?:password|passwd|token|secret)\s*[:=]\s*)\S+', '\1***', 'gi') as message from documents""",
)
def redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in whole given texts."""
    return table(spark, folder, "documents").select("doc_id", redact("text").alias("message"))


@query(
    "F18",
    """select event_id, concat(case when event_type = 'view' then '' else concat('[', event_type, '] ') end,
      props) as message from events""",
)
def prefixed(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, folder, "events").select(
        "event_id", step_prefix(label, "props").alias("message")
    )


@query(
    "U1",
    """select 'documents' as origin, doc_id as entry, length(text) as n_chars from documents
    union all
    select 'conversations', conv_id, length(text) from conversations""",
)
def log_append(spark: SparkSession, folder: str) -> DataFrame:
    def part(name: str, key: str) -> DataFrame:
        return table(spark, folder, name).select(
            F.lit(name).alias("origin"), F.col(key).alias("entry"),
            F.length("text").cast("long").alias("n_chars"),
        )

    return logs.append_logs(part("documents", "doc_id"), part("conversations", "conv_id"))


@query(
    "W4",
    """select user_id, event_id,
      row_number() over (partition by user_id order by ts, event_id) as position,
      count(*) over (partition by user_id) as n_steps,
      cast(row_number() over (partition by user_id order by ts, event_id) * 100.0 as double)
        / count(*) over (partition by user_id) as progress
    from events""",
)
def step_progress(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return logs.step_progress(events, "user_id", ["ts", "event_id"]).select(
        "user_id", "event_id", "position", "n_steps",
        F.col("progress").cast("double").alias("progress"),
    )


_STATES_SQL = """states as (
      select user_id as run_id, json_extract(props, '$.k')::int as step,
        arg_max(case event_type when 'purchase' then 'completed' when 'error' then 'error'
          else 'running' end, {'a': ts, 'b': event_id}) as status,
        max(ts) as changed_at, count(*) filter (where event_type = 'error') as errors
      from events group by 1, 2)"""


def _step_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "error") \
        .otherwise("running")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.get_json_object("props", "$.k").cast("int").alias("step"),
        status.alias("status"), "ts", F.col("event_id").alias("seq"), "event_type",
    )


def _states(events: DataFrame) -> DataFrame:
    return logs.latest_states(
        _step_events(events), is_error=F.col("event_type") == "error"
    )


def _shown(states: DataFrame) -> DataFrame:
    return states.select(
        "run_id", "step", "status",
        F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss").alias("changed_at"), "errors",
    )


_SHOWN_SQL = """select run_id, step, status, strftime(changed_at, '%Y-%m-%d %H:%M:%S') as changed_at,
      errors from states"""


@query("T3", f"with {_STATES_SQL} {_SHOWN_SQL}")
def run_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_states(table(spark, folder, "events")))


@query(
    "T3",
    f"""with {_STATES_SQL},
    resets as (select user_id, max(ts) as reset_at from events where event_type = 'signup' group by 1)
    select run_id, step, case when reset_at >= changed_at then 'idle' else status end as status
    from states left join resets on run_id = user_id""",
)
def run_reset(spark: SparkSession, folder: str) -> DataFrame:
    """A sign-up stands for a stop: it puts the earlier steps of its run back to idle."""
    events = table(spark, folder, "events")
    resets = events.where("event_type = 'signup'").select(F.col("user_id").alias("run_id"), "ts")
    return logs.reset_states(_states(events), resets).select("run_id", "step", "status")


@query(
    "T4 A8",
    f"""with {_STATES_SQL}
    select run_id, count(*) as n_steps, case when bool_or(status = 'error') then 'error'
      when bool_or(status = 'running') then 'running'
      when bool_or(status = 'completed') then 'completed' else 'idle' end as run_status
    from states group by 1""",
)
def run_status(spark: SparkSession, folder: str) -> DataFrame:
    return logs.run_status(_states(table(spark, folder, "events")))


@query(
    "T3",
    """with attempts as (
      select *, l_linenumber = 1 or l_linestatus = 'O' as runs, l_returnflag = 'R' as failed
      from lineitem),
    ends as (
      select l_orderkey, min(l_linenumber) filter (where runs and failed and l_linenumber >= 3) as e
      from attempts group by 1)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case when not runs or l_linenumber > e then 'idle'
        when runs and failed and l_linenumber >= 3 then 'error' else 'completed' end as status,
      runs and failed and (e is null or l_linenumber <= e) as has_error,
      not runs and (e is null or l_linenumber <= e) as skipped
    from attempts join ends using (l_orderkey)""",
)
def step_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a run, its lines the steps; open lines are enabled, from line 3 a failure stops."""
    attempts = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag",
        (F.col("l_linenumber") - 1).alias("step"),
    )
    return logs.step_outcomes(
        attempts, "l_orderkey", "step",
        enabled=F.col("l_linestatus") == "O",
        failed=F.col("l_returnflag") == "R",
        stops=F.col("step") >= 2,
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "has_error", "skipped"
    )


@query(
    "F28",
    """select user_id as run_id, count(*) as n_events,
      (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as elapsed_ms from events group by 1""",
)
def run_elapsed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("user_id").alias("run_id"), "ts")
    return logs.run_elapsed(events)


@query(
    "F29",
    """select event_id, case when value < 50 then 'success' when value < 80 then 'warning'
      else 'error' end as band, printf('%.1f%%', case when value - floor(value) = 0.25 then value + 0.01 else value end) as usage
    from events""",
)
def usage_bands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", usage_band("value").alias("band"), percent_text("value").alias("usage")
    )


@query(
    "S10",
    """select event_id as run_id, event_type <> 'error' as success, props as output,
      case when event_type <> 'error' then null when value >= 50 then concat('failed at ', user_id)
        when event_id % 2 = 0 then 'exit code: null' else 'exit code: 1' end as error,
      cast(floor(value) as bigint) as execution_ms
    from events""",
)
def script_results(spark: SparkSession, folder: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    runs = table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(~failed, 0).when(F.col("event_id") % 2 == 1, 1).alias("exit_code"),
        F.col("props").alias("stdout"),
        F.when(failed & (F.col("value") >= 50),
               F.concat(F.lit("failed at "), F.col("user_id").cast("string")))
        .otherwise("").alias("stderr"),
        F.floor("value").cast("long").alias("execution_ms"),
    )
    return tables.script_results(runs)


_PREFIX = "脚本输出（中文）："


@query(
    "F15",
    f"""select doc_id, case when doc_id % 2 = 0
        then concat('{_PREFIX}', regexp_replace(text, '[^\x00-\x7F]', '文', 'g')) else text end as message
    from documents""",
)
def decode_output(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as console bytes: every other one from Windows in GBK, others in UTF-8.

    GBK lacks some letters of the texts; those are Chinese ones here.
    """
    windows = F.col("doc_id") % 2 == 0
    text = F.concat(F.lit(_PREFIX), F.regexp_replace("text", r"[^\x00-\x7F]", "文"))
    rows = table(spark, folder, "documents").select("doc_id", "text", windows.alias("windows"), text.alias("chinese"))
    gbk = encode_gbk(F.when(F.col("windows"), F.col("chinese")))
    raw = F.when(F.col("windows"), gbk).otherwise(F.encode("text", "UTF-8"))
    return rows.select("doc_id", raw.alias("raw"), "windows").select(
        "doc_id", decoded(F.col("raw"), F.col("windows")).alias("message")
    )


@query(
    "S5",
    """select 'scan-' || left(o_orderpriority, 1) as folder,
      cast(sum(length(cast(o_custkey as varchar)) + 1) as bigint) as size
    from orders group by 1""",
)
def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that the query writes itself, found again by folder and size; those of another suffix are not listed."""
    path = scratch_path(spark, "scans")
    rows = table(spark, folder, "orders").select(
        F.concat(F.lit("scan-"), F.left("o_orderpriority", F.lit(1))).alias("scan"),
        F.col("o_custkey").cast("string").alias("value"),
    )
    rows.write.partitionBy("scan").text(path)
    rows.write.partitionBy("scan").mode("append").json(path)
    found = tables.list_files(spark, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", "scan=([^/]+)/", 1).alias("folder")).agg(F.sum("size").alias("size"))


# --- the same operators on a stream of the events file ----------------------

@query(
    "T1 T2 S6",
    f"""with {_LOG_SQL}
    select run_id, level, count(*) as total,
      count(*) filter (where contains(lower(message), lower('{TERM}'))) as matching
    from logs group by 1, 2""",
)
def log_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "log-counts")
    entries = logs.log_entries(_output(_event_stream(spark, folder)))
    streams.update_table(logs.log_counts(entries, TERM), path, ["run_id", "level"]).awaitTermination()
    return streams.read_updated(spark, path, ["run_id", "level"])


@query("T1 U1 S6", f"with {_LOG_SQL} select run_id, seq, level, message from logs")
def log_append_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "log-append")
    entries = logs.log_entries(_output(_event_stream(spark, folder)))
    streams.append_table(entries, path).awaitTermination()
    return streams.read_appended(spark, path).select("run_id", "seq", "level", "message")


@query(
    "T3 T4",
    f"""with {_STATES_SQL}
    select run_id, count(*) as n_steps, case when bool_or(status = 'error') then 'error'
      when bool_or(status = 'running') then 'running'
      when bool_or(status = 'completed') then 'completed' else 'idle' end as run_status
    from states group by 1""",
)
def run_status_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Step states kept up to date by a stream; run status from the table it writes."""
    path = scratch_path(spark, "step-states")
    streams.update_table(_states(_event_stream(spark, folder)), path, ["run_id", "step"]).awaitTermination()
    return logs.run_status(streams.read_updated(spark, path, ["run_id", "step"]))


def _machine_rows(spark: SparkSession, folder: str, name: str, events: DataFrame) -> DataFrame:
    """The newest row of each run after the whole stream."""
    path = scratch_path(spark, name)
    with machine.keyed_state(spark):
        streams.update_table(machine.run_steps(events), path, ["run_id"]).awaitTermination()
    return streams.read_updated(spark, path, ["run_id"])


@query(
    "T3",
    """with attempts as (
      select user_id as run_id, json_extract(props, '$.k')::int as step,
        arg_max({'enabled': value >= 20, 'failed': event_type = 'error'}, {'a': ts, 'b': event_id}) as last
      from events group by 1, 2),
    judged as (
      select run_id, step, step = 0 or last.enabled as runs, last.failed as failed, step >= 60 as stops from attempts),
    ends as (select run_id, min(step) filter (where runs and failed and stops) as e from judged group by 1)
    select run_id, step,
      case when not runs or step > e then 'idle' when failed and stops then 'error' else 'completed' end as status,
      runs and failed and (e is null or step <= e) as has_error,
      not runs and (e is null or step <= e) as skipped
    from judged join ends using (run_id)""",
)
def step_outcomes_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A step's last attempt counts; low values are disabled, and an error from step 60 on ends the run."""
    events = _event_stream(spark, folder).withColumn("step", F.get_json_object("props", "$.k").cast("int"))
    failed, stops = F.col("event_type") == "error", F.col("step") >= 60
    rows = machine.step_events(
        events, "user_id", F.col("step"), "ts", "event_id",
        F.when(failed & stops, "error").otherwise("completed"),
        enabled=F.col("value") >= 20, failed=failed, stops=stops,
    )
    runs = _machine_rows(spark, folder, "step-outcomes", rows)
    return machine.exploded_steps(runs).drop("changed_at")


def _reported(events: DataFrame) -> DataFrame:
    """Step changes as reported; a sign-up stops its run."""
    rows = _step_events(events)
    return machine.step_events(
        rows, "run_id", F.col("step"), "ts", "seq", F.col("status"), resets=F.col("event_type") == "signup"
    )


@query("T3", REGISTRY["run_reset"].sql)
def run_reset_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stops put earlier steps back to idle while the stream runs."""
    runs = _machine_rows(spark, folder, "run-reset", _reported(_event_stream(spark, folder)))
    return machine.exploded_steps(runs).select("run_id", "step", "status")


@query("T4", f"""with r as ({REGISTRY["run_reset"].sql})
    select run_id, count(*) as n_steps, case when bool_or(status = 'error') then 'error'
      when bool_or(status = 'running') then 'running'
      when bool_or(status = 'completed') then 'completed' else 'idle' end as run_status
    from r group by 1""")
def run_status_live(spark: SparkSession, folder: str) -> DataFrame:
    """One kept row for each run, written by the machine; reading it reads no history."""
    runs = _machine_rows(spark, folder, "run-status", _reported(_event_stream(spark, folder)))
    return runs.select("run_id", "n_steps", "run_status")


@query(
    "T2 A6",
    f"""with {_LOG_SQL},
    timed as (
      select l.*, l.ts + to_minutes(cast(floor(value) as bigint)) as received
      from logs l join events on event_id = seq),
    counted as (
      select *, received > ts + interval 60 minutes as late,
        case when received > ts + interval 60 minutes then received else ts end as counted_at
      from timed),
    spans as (
      select *, time_bucket(interval 6 hours, counted_at, timestamp '1970-01-01') as since from counted),
    mark as (select date_trunc('milliseconds', max(counted_at)) - interval 60 minutes as w from counted)
    select strftime(since, '%Y-%m-%d %H:%M:%S') as since, late, level, count(*) as total,
      count(*) filter (where contains(lower(message), lower('{TERM}'))) as matching
    from spans, mark where since + interval 6 hours <= w group by 1, 2, 3""",
)
def log_windows_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of every six hours that are over; what came more than an hour after its time is counted apart."""
    path = scratch_path(spark, "log-windows")
    events = _event_stream(spark, folder)
    received = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))
    entries = _output(events.withColumn("received", received), "received")
    entries = logs.log_entries(entries, "received")
    counts = logs.windowed_counts(entries, TERM, "6 hours", "60 minutes", ["level"])
    streams.append_table(counts, path).awaitTermination()
    return streams.read_appended(spark, path).select(
        F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "late", "level", "total", "matching"
    )


@query("T1", f"with {_LOG_SQL} select run_id, seq, level, message from logs")
def log_once_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every third chunk comes twice, the second time five minutes later; each appears once."""
    path = scratch_path(spark, "log-once")
    events = _event_stream(spark, folder)
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    sent = events.withColumn("late_by", F.explode(again))
    received = sent.withColumn("received", F.col("ts") + F.make_dt_interval(mins=F.col("late_by")))
    entries = logs.log_entries(_output(received, "received"), "received")
    streams.append_table(logs.once(entries, within="1 hour"), path).awaitTermination()
    return streams.read_appended(spark, path).select("run_id", "seq", "level", "message")
