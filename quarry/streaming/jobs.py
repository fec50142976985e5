"""Structured Streaming variants of the batch jobs.

Per-run state lives in Spark's own streaming aggregation; sinks append one folder per
micro-batch (``batch_id=<n>``, overwritten when a batch is retried) and readers take the newest
row per key.  Checkpoints live in the shared checkpoint folder, and every job can run with
``availableNow`` (drain and stop) or a processing-time trigger.  The state read back from a sink
equals the batch operator over the same input, whatever the micro-batches and their order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lake import newest_rows
from ..operators.runs import STALL_LIMIT_S, TERMINAL_STATES, status_of
from ..session import scratch_path


def run_folder(spark: SparkSession, job: str) -> tuple[str, str]:
    """(sink, checkpoint) folders for one run of a job, under the shared
    checkpoint folder; each run takes a fresh folder."""
    base = scratch_path(spark, f"{job}-{uuid.uuid4().hex[:12]}")
    return f"{base}/sink", f"{base}/checkpoint"


def _start(writer, trigger: str | None):
    if trigger is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=trigger)
    return writer.start()


def _append_batches(stream: DataFrame, sink: str, checkpoint: str, trigger: str | None, mode: str = "append"):
    """Write every micro-batch to its own folder.  The sink is created empty first, so that a
    reader finds its schema before the first batch and an unreadable sink is an error."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{sink}/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _start(stream.writeStream.outputMode(mode).foreachBatch(step)
                  .option("checkpointLocation", checkpoint), trigger)


# --------------------------------------------------------------- ingest
def stream_ingest(files: DataFrame, index_root: str, checkpoint: str, map_fn,
                  trigger: str | None = None):
    """Index documents as they arrive, merge-on-read: a micro-batch writes only its own rows, and
    :func:`read_current_index` takes the newest row per key over all of them."""
    return _append_batches(map_fn(files), index_root, checkpoint, trigger)


def read_current_index(spark: SparkSession, index_root: str, key: str = "id",
                       version: str = "last_modified") -> DataFrame:
    """Current index: the newest ``version`` per key (a later batch wins a tie)."""
    return newest_rows(spark.read.parquet(index_root), key, [version, "batch_id"]).drop("batch_id")


# --------------------------------------------------------------- run state
def run_states(events: DataFrame) -> DataFrame:
    """Per run: its first event time and its latest (ts, event_id, state), as one aggregate (a
    streaming one on a streaming input, kept in Spark's state store)."""
    st = status_of(F.col("status"), F.col("runStatus"))
    ev = events.where(st.isNotNull()).select("run_id", "event_id", "ts", st.alias("state"))
    return ev.groupBy("run_id").agg(F.min("ts").alias("first_ts"),
                                    F.max(F.struct("ts", "event_id", "state")).alias("last"))


def stream_latest_state(events: DataFrame, sink: str, checkpoint: str, trigger: str | None = None):
    """Live current state per run: the streaming aggregate's updated rows, a micro-batch at a time."""
    return _append_batches(run_states(events), sink, checkpoint, trigger, mode="update")


def read_latest_state(spark: SparkSession, sink: str) -> DataFrame:
    """Current state per run over all updates: the latest (ts, event_id) row and the earliest
    event time.  Late events can only add earlier rows, so the newest row stays."""
    ch = spark.read.parquet(sink)
    return (ch.groupBy("run_id").agg(F.max("last").alias("last"), F.min("first_ts").alias("first_ts"))
            .select("run_id", F.col("last.state").alias("state"), "first_ts", F.col("last.ts").alias("last_ts"))
            .withColumn("terminal", F.col("state").isin(TERMINAL_STATES)))


# --------------------------------------------------------------- telemetry
def stream_telemetry(records: DataFrame, sink: str, checkpoint: str, delay: str = "1 hour",
                     keys=("RunId", "Workflow"), trigger: str | None = None):
    """Append telemetry, dropping records (same run id and workflow) re-sent within ``delay`` of
    their first arrival.  The watermark is on the time of arrival, which only grows: records with
    a late or missing event time are neither dropped nor able to make others late; one that is sent
    again later than ``delay`` is kept twice."""
    arrived = records.withColumn("_arrived", F.current_timestamp())
    deduped = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")
    return _append_batches(deduped, sink, checkpoint, trigger)


def read_telemetry(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch_id")


# --------------------------------------------------------------- stalled runs
def stream_stalled_runs(events: DataFrame, sink: str, checkpoint: str, trigger: str | None = None):
    """Keep what the stalled-run alarm needs: the streaming aggregate of :func:`run_states`.  A run is
    judged when the alarm is read, against the largest event time then seen, so a run that closes
    later, or whose late events were still on the way, is never reported as stalled."""
    return _append_batches(run_states(events), sink, checkpoint, trigger, mode="update")


def read_stalled_runs(spark: SparkSession, sink: str, limit_s: int = STALL_LIMIT_S, delay_s: int = 0) -> DataFrame:
    """One row per run whose latest state is not terminal ``limit_s`` seconds (event time) after its
    first event, against the largest event time seen minus ``delay_s``."""
    runs = read_latest_state(spark, sink)
    now = F.timestamp_add("SECOND", F.lit(-delay_s), runs.select(F.max("last_ts")).scalar())
    due = F.timestamp_add("SECOND", F.lit(limit_s), F.col("first_ts")) < now
    return runs.where(~F.col("terminal") & due).drop("terminal")


# --------------------------------------------------------------- stalled-run alarm
# Chosen here: groups of runs that share a state and a timer.  A micro-batch costs some calls a group, whatever the
# number of runs; a group's runs are one small table.
ALARM_GROUPS = 512
_OPEN = 2**63 - 1  # no closing event yet


def _alarm(limit_ms: int, keep_ms: int | None):
    """The state function of :func:`stalled_run_alarm`: a group's runs (first event and first closing in
    microseconds, whether judged, when to forget) as one Arrow table, and one event-time timer a group."""
    import pandas as pd
    import pyarrow as pa

    def judge(key, parts, state):
        now = state.getCurrentWatermarkMs()
        known = []
        if state.exists:
            with pa.ipc.open_stream(state.get[0]) as held:
                known.append(held.read_pandas().assign(fresh=False))
        if not state.hasTimedOut:
            new = pd.concat(list(parts), ignore_index=True)
            known.append(pd.DataFrame({"run_id": new["run_id"], "first": new["us"], "closed": new["us"].where(new["terminal"], _OPEN),
                                       "judged": False, "until": 0, "fresh": True}))
        runs = (pd.concat(known, ignore_index=True).groupby("run_id", sort=False)
                .agg({"first": "min", "closed": "min", "judged": "max", "until": "max", "fresh": "max"}).reset_index())
        if keep_ms is not None:  # a judged run that was silent for ``keep`` is forgotten, one with events is not
            runs.loc[runs["judged"] & runs["fresh"], "until"] = now + keep_ms + 1
            runs = runs[~runs["judged"] | (runs["until"] >= now)]
        due = runs["first"] // 1000 + limit_ms
        ripe = ~runs["judged"] & (due < now)
        alarms = runs[ripe & (runs["closed"] > runs["first"] + limit_ms * 1000)]
        runs = runs.assign(judged=runs["judged"] | ripe)
        if keep_ms is not None:
            runs.loc[ripe, "until"] = (due[ripe] + keep_ms).clip(lower=now + 1)
        if len(runs):
            table = pa.Table.from_pandas(runs.drop(columns="fresh"), preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
            timers = due[~runs["judged"]] if keep_ms is None else due.where(~runs["judged"], runs["until"])
            if len(timers):
                state.setTimeoutTimestamp(max(int(timers.min()), now + 1))
        elif state.exists:
            state.remove()
        if len(alarms):
            yield pd.DataFrame({"run_id": alarms["run_id"], "first_us": alarms["first"]})
    return judge


def stalled_run_alarm(events: DataFrame, delay: str, limit_s: int = STALL_LIMIT_S, keep_s: int | None = None) -> DataFrame:
    """(run_id, first_ts, due_ts) of every run without a terminal state ``limit_s`` seconds after its first
    event, as a stream: a run's row comes out by itself, once, when the watermark (largest event time minus
    ``delay``) passes its due time.

    A run's state is two times and a flag, whatever the number of its events, so events may come in any
    order within ``delay``: an earlier first event moves the due time, a late closing at or before it takes
    the alarm back.  Runs are kept in ``ALARM_GROUPS`` groups by their hash, with one event-time timer a
    group for its next due time.  A judged run is remembered (later events of it raise no second alarm) for
    ``keep_s`` seconds of event time without events, by default for good.  Events without a time, run or
    state are ignored."""
    st = status_of(F.col("status"), F.col("runStatus"))
    ev = (events.where(st.isNotNull() & F.col("ts").isNotNull() & F.col("run_id").isNotNull())
          .select("run_id", F.col("ts").cast("timestamp").alias("at"), st.isin(TERMINAL_STATES).alias("terminal"))
          .withWatermark("at", delay).select("run_id", "at", "terminal", F.unix_micros("at").alias("us")))
    kind = dict(events.dtypes)["run_id"]
    group = F.pmod(F.xxhash64("run_id"), F.lit(ALARM_GROUPS))
    fired = ev.withColumn("alarm_group", group).groupBy("alarm_group").applyInPandasWithState(
        _alarm(limit_s * 1000, None if keep_s is None else keep_s * 1000), f"run_id {kind}, first_us long",
        "runs binary", "append", "EventTimeTimeout")
    ts = dict(events.dtypes)["ts"]
    first = F.timestamp_micros("first_us")
    return fired.select("run_id", first.cast(ts).alias("first_ts"),
                        F.timestamp_add("SECOND", F.lit(limit_s), first).cast(ts).alias("due_ts"))


def stream_run_alarm(events: DataFrame, sink: str, checkpoint: str, delay: str, limit_s: int = STALL_LIMIT_S,
                     keep_s: int | None = None, trigger: str | None = None):
    """Append the alarms of :func:`stalled_run_alarm` to ``sink``, a folder a micro-batch."""
    return _append_batches(stalled_run_alarm(events, delay, limit_s, keep_s), sink, checkpoint, trigger)


def read_run_alarm(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch_id")
