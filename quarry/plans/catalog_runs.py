"""Registered queries: run telemetry, attempts and outcomes (SURVEY §2.4,
§2.5, §2.10 batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formats import TELEMETRY_WORKSPACE_FIELD as WS_FIELD
from ..operators import reconcile as rc
from ..operators import runs as rn
from ..sources import sinks
from . import fixtures as fx
from .catalog_columns import CLASSIFY_SQL
from .catalog_governance import RECONCILE_SQL
from .registry import oracle_for, register

NOW_SQL = f"TIMESTAMP '{fx.NOW}'"


@register("run_report", f"""WITH {fx.RUNS_SQL}
SELECT indexer,
       arg_max(status, (start, run_id)) AS last_status,
       arg_max(itemsProcessed, (start, run_id)) AS last_processed,
       arg_max(itemsFailed, (start, run_id)) AS last_failed,
       arg_max(start, (start, run_id)) AS last_start,
       arg_max("end", (start, run_id)) AS last_end,
       arg_max_null(errorMessage, (start, run_id)) AS last_error_message,
       count(*) AS runs,
       CAST(sum(itemsProcessed) AS BIGINT) AS total_processed,
       CAST(sum(itemsFailed) AS BIGINT) AS total_failed,
       CAST(count_if(status <> 'success') AS BIGINT) AS unsuccessful_runs,
       arg_max(errors, (start, run_id)) AS last_errors, arg_max(warnings, (start, run_id)) AS last_warnings,
       CAST(sum(n_errors) AS BIGINT) AS total_errors, CAST(sum(n_warnings) AS BIGINT) AS total_warnings,
       arg_max(errorMessage, CASE WHEN errorMessage IS NOT NULL THEN (start, run_id) END) AS last_error
FROM runs GROUP BY indexer""")
def q_run_report(spark, sf):
    return rn.run_report(fx.runs(spark, sf))


@register("last_n_runs", f"""WITH {fx.RUNS_SQL}
SELECT * EXCLUDE (n_errors, n_warnings), CAST(row_number() OVER (PARTITION BY indexer ORDER BY start DESC, run_id DESC) AS INTEGER) AS recency
FROM runs QUALIFY recency <= 3""")
def q_last_n_runs(spark, sf):
    last = rn.last_n_runs(fx.runs(spark, sf), 3)
    return last.withColumns({c: rn.messages(c) for c in ("errors", "warnings")})


LATEST_SQL = f"""{fx.STATUS_SQL},
latest AS (
  SELECT run_id, arg_max(coalesce(status, runStatus), (ts, event_id)) AS state, min(ts) AS first_ts, max(ts) AS last_ts
  FROM status_events WHERE coalesce(status, runStatus) IS NOT NULL GROUP BY run_id)"""


@register("latest_state", f"""WITH {LATEST_SQL}
SELECT *, state IN ('Succeeded', 'Failed', 'Cancelled') AS terminal FROM latest""")
def q_latest_state(spark, sf):
    return rn.latest_state(fx.status_events(spark, sf))


@register("stalled_runs", f"""WITH {LATEST_SQL}
SELECT run_id, state, first_ts, last_ts, date_sub('second', first_ts, {NOW_SQL}) AS age_s FROM latest
WHERE state NOT IN ('Succeeded', 'Failed', 'Cancelled') AND date_sub('second', first_ts, {NOW_SQL}) > 900""")
def q_stalled_runs(spark, sf):
    return rn.stalled_runs(fx.status_events(spark, sf), fx.now_lit(), 900)


ATTEMPT_LOG_SQL = f"""{fx.ATTEMPTS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS attempt FROM attempts QUALIFY attempt <= 6),
cls AS (SELECT *, {CLASSIFY_SQL} AS class FROM numbered),
total AS (SELECT item, count(*) AS every FROM attempts GROUP BY item),
g AS (SELECT item, arg_min(class, CASE WHEN class <> 'retry' THEN attempt END) AS ft,
             min(CASE WHEN class <> 'retry' THEN attempt END) AS fa, count(*) AS seen FROM cls GROUP BY item),
alog AS (SELECT item, CASE WHEN ft IS NOT NULL THEN ft WHEN seen >= 6 THEN 'exhausted' ELSE 'pending' END AS outcome,
                CAST(coalesce(fa, seen) AS INTEGER) AS attempts_used, CAST(every AS INTEGER) AS attempts_seen FROM g JOIN total USING (item))"""


@register("attempt_log", f"WITH {ATTEMPT_LOG_SQL} SELECT * FROM alog")
def q_attempt_log(spark, sf):
    return rc.attempt_log(fx.attempts(spark, sf), cap=6)


@register("outcome_summary", f"""WITH {ATTEMPT_LOG_SQL}, {RECONCILE_SQL},
u AS (SELECT 'plan' AS step, CASE WHEN action = 'skip' THEN 'skipped' ELSE 'pending' END AS outcome FROM plan
      UNION ALL SELECT 'attempts', outcome FROM alog)
SELECT step, CAST(count_if(outcome IN ('created', 'present')) AS BIGINT) AS created,
       CAST(count_if(outcome IN ('skip', 'skipped')) AS BIGINT) AS skipped,
       CAST(count_if(outcome IN ('failed', 'unsupported', 'exhausted')) AS BIGINT) AS failed,
       CAST(count_if(outcome NOT IN ('created', 'present', 'skip', 'skipped', 'failed', 'unsupported', 'exhausted')) AS BIGINT) AS pending
FROM u GROUP BY step""")
def q_outcome_summary(spark, sf):
    plan = rc.reconcile(fx.desired_items(spark, sf), fx.existing_items(spark, sf))
    planned = rc.plan_outcomes(plan).select(F.lit("plan").alias("step"), "outcome")
    alog = rc.attempt_log(fx.attempts(spark, sf), cap=6).select(F.lit("attempts").alias("step"), "outcome")
    return rc.outcome_summary(planned.unionByName(alog), ["step"])


@register("telemetry_by_run", f"""WITH {fx.TELEMETRY_SQL} SELECT * FROM telemetry WHERE RunId = 'run-4242'""")
def q_telemetry_by_run(spark, sf):
    return rn.telemetry_by_run(fx.telemetry(spark, sf), "run-4242")


@register("write_telemetry", f"""WITH {fx.TELEMETRY_SQL},
f AS (SELECT RunId, Workflow, Status, Duration,
             strftime(coalesce("Timestamp", {NOW_SQL}), '%Y-%m-%dT%H:%M:%S.%fZ') AS ts, {WS_FIELD} FROM telemetry),
r AS (SELECT RunId, '{{"RunId":' || to_json(RunId) || ',"Workflow":' || to_json(Workflow) || ',"Status":' || to_json(Status)
             || ',"Duration":' || CAST(Duration AS VARCHAR) || ',"Timestamp":' || to_json(ts)
             || ',"{WS_FIELD}":' || CAST({WS_FIELD} AS VARCHAR) || '}}' AS record FROM f)
SELECT RunId, record, CAST(octet_length(encode(record)) AS BIGINT) AS bytes FROM r""")
def q_write_telemetry(spark, sf):
    return rn.telemetry_records(fx.telemetry(spark, sf), fx.now_lit())


@register("write_telemetry_file", oracle_for("write_telemetry").replace(
    "SELECT RunId, record, CAST(octet_length(encode(record)) AS BIGINT) AS bytes FROM r", "SELECT record AS value FROM r"))
def q_write_telemetry_file(spark, sf):
    import uuid
    from ..session import scratch_path
    path = scratch_path(spark, f"telemetry-{uuid.uuid4().hex[:12]}")
    sinks.write_telemetry(fx.telemetry(spark, sf), path, fx.now_lit())
    return spark.read.text(path)
