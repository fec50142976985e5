"""Run telemetry: reports, last-N runs, latest state, stalled runs.

Per-key "latest"/"first" selections are aggregates (``max_by`` over a struct
ordering), which Spark combines map-side, so a key holding a third of all
rows never lands whole in one task.  Last-N uses ``row_number() <= n``,
planned with a partial group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Terminal run states.
TERMINAL_STATES = ["Succeeded", "Failed", "Cancelled"]
# Fixed value: resume timeout in seconds.
STALL_LIMIT_S = 900


def run_report(runs: DataFrame, key: str = "indexer") -> DataFrame:
    """Per indexer: the last run (status, processed, failed, start, end,
    error, its errors and warnings as text) and totals over all runs."""
    last = F.max_by(F.struct("status", "itemsProcessed", "itemsFailed", "start", "end", "errorMessage",
                             messages("errors").alias("errors"), messages("warnings").alias("warnings")),
                    F.struct("start", "run_id"))
    g = runs.groupBy(key).agg(
        last.alias("_l"),
        F.count(F.lit(1)).alias("runs"),
        F.sum("itemsProcessed").alias("total_processed"),
        F.sum("itemsFailed").alias("total_failed"),
        F.count_if(F.col("status") != F.lit("success")).alias("unsuccessful_runs"),
        F.sum(F.size("errors")).alias("total_errors"),
        F.sum(F.size("warnings")).alias("total_warnings"),
        F.max_by("errorMessage", F.when(F.col("errorMessage").isNotNull(), F.struct("start", "run_id")))
        .alias("last_error"))
    return g.select(key,
                    F.col("_l.status").alias("last_status"),
                    F.col("_l.itemsProcessed").alias("last_processed"),
                    F.col("_l.itemsFailed").alias("last_failed"),
                    F.col("_l.start").alias("last_start"),
                    F.col("_l.end").alias("last_end"),
                    F.col("_l.errorMessage").alias("last_error_message"),
                    F.col("_l.errors").alias("last_errors"),
                    F.col("_l.warnings").alias("last_warnings"),
                    "runs", "total_processed", "total_failed", "unsuccessful_runs", "total_errors",
                    "total_warnings", "last_error")


def messages(col: str, sep: str = "; ") -> Column:
    """``key: message`` of every entry of an array of (key, message) structs."""
    return F.array_join(F.transform(col, lambda m: F.concat_ws(": ", m["key"], m["message"])), sep)


def last_n_runs(runs: DataFrame, n: int = 3, key: str = "indexer") -> DataFrame:
    """The last n runs per indexer, newest first (start desc, run id desc)."""
    w = Window.partitionBy(key).orderBy(F.col("start").desc(), F.col("run_id").desc())
    return runs.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def status_of(status: Column, run_status: Column) -> Column:
    """The status may arrive under either of two field names."""
    return F.coalesce(status, run_status)


def latest_state(events: DataFrame, key: str = "run_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Current state per run and whether it is terminal."""
    st = status_of(F.col("status"), F.col("runStatus"))
    g = events.where(st.isNotNull()).groupBy(key).agg(
        F.max_by(st, F.struct(ts, tie)).alias("state"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"))
    return g.withColumn("terminal", F.col("state").isin(TERMINAL_STATES))


def stalled_runs(events: DataFrame, now: Column, limit_s: int = STALL_LIMIT_S) -> DataFrame:
    """Runs with no terminal state ``limit_s`` seconds after their first event."""
    ls = latest_state(events)
    age = F.timestamp_diff("SECOND", F.col("first_ts"), now)
    return (ls.where(~F.col("terminal") & (age > F.lit(limit_s)))
            .select("run_id", "state", "first_ts", "last_ts", age.alias("age_s")))


def telemetry_by_run(df: DataFrame, run_id: str, col: str = "RunId") -> DataFrame:
    return df.where(F.col(col) == F.lit(run_id))


def fill_timestamp(df: DataFrame, now: Column, col: str = "Timestamp") -> DataFrame:
    """Missing event time becomes ``now`` (UTC)."""
    return df.withColumn(col, F.coalesce(F.col(col), now))


# ISO-8601 UTC rendering of event time.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def telemetry_records(df: DataFrame, now: Column, col: str = "Timestamp") -> DataFrame:
    """Compact JSON record per event and its UTF-8 byte size."""
    filled = fill_timestamp(df, now, col)
    rendered = filled.withColumn(col, F.date_format(F.col(col), ISO_FORMAT))
    js = F.to_json(F.struct(*[F.col(c) for c in rendered.columns]))
    return rendered.select("RunId", js.alias("record")).withColumn(
        "bytes", F.octet_length("record").cast("bigint"))
