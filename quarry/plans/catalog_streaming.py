"""Registered queries: Structured Streaming jobs.

Each query writes its driver table as files in several waves (events by time, some of them a wave
late), drains them as a file stream of at least four micro-batches (``availableNow``) into a fresh
folder under the shared checkpoint folder, and returns what its reader makes of the sink.  That
equals the batch operators, so the batch SQL is the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import TELEMETRY_WORKSPACE_FIELD
from ..operators import index as ix
from ..operators import runs as rn
from ..session import scratch_path
from ..sources import reports as rp
from ..sources.sinks import write_index
from ..streaming import index as si
from ..streaming import jobs as sj
from . import fixtures as fx
from . import catalog_lake  # noqa: F401  (registers upsert_index, whose SQL is reused)
from .catalog_runs import LATEST_SQL
from .catalog_search import SEARCH_QUERY, corpus_stats_sql, search_sql
from .registry import oracle_for, register


WAVES = 4


def waves_of(df: DataFrame, wave: Column, name: str, waves: int = WAVES) -> DataFrame:
    """A file stream over ``df``, delivered in at least ``waves`` micro-batches: the rows of each
    wave (0 to waves - 1) are written after one another, and a batch takes a share of the files."""
    spark = df.sparkSession
    path = scratch_path(spark, f"waves-{name}-{uuid.uuid4().hex[:12]}")
    for k in range(waves):
        df.where(wave == k).write.mode("append").option("compression", "zstd").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // waves)).parquet(path))


def event_waves(spark: SparkSession, sf_dir: str, waves: int = WAVES) -> DataFrame:
    """The events in the order of their times, in equal spans of time; every 17th event comes one wave
    late."""
    e = fx.table(spark, sf_dir, "events")
    lo, hi = (e.select(f(F.unix_micros(F.col("ts").cast("timestamp")))).scalar() for f in (F.min, F.max))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.floor((at - lo) * waves / (hi - lo + 1)).cast("int")
    wave = F.least(F.lit(waves - 1), span + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0))
    return waves_of(e, wave, "events", waves)


def table_waves(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A driver table in four deliveries by key."""
    return waves_of(fx.table(spark, sf_dir, name), (F.col(key) % WAVES).cast("int"), name)


@register("stream_latest_state", f"""WITH {LATEST_SQL}
SELECT *, state IN ('Succeeded', 'Failed', 'Cancelled') AS terminal FROM latest""")
def q_stream_latest_state(spark, sf):
    sink, ckpt = sj.run_folder(spark, "latest-state")
    q = sj.stream_latest_state(fx.status_events_from(event_waves(spark, sf)), sink, ckpt)
    q.awaitTermination()
    return sj.read_latest_state(spark, sink)


@register("stream_telemetry", f"""WITH {fx.TELEMETRY_SQL}
SELECT RunId, Workflow, Status, Duration, coalesce("Timestamp", TIMESTAMP '{fx.NOW}') AS "Timestamp", {TELEMETRY_WORKSPACE_FIELD}
FROM telemetry""")
def q_stream_telemetry(spark, sf):
    sink, ckpt = sj.run_folder(spark, "telemetry")

    # the same deliveries arrive twice; the dedup keeps one copy.  Missing event times stay missing
    # in the stream and are filled when read
    once, again = (fx.telemetry_from(event_waves(spark, sf)) for _ in range(2))
    q = sj.stream_telemetry(once.unionByName(again), sink, ckpt)
    q.awaitTermination()
    return rn.fill_timestamp(sj.read_telemetry(spark, sink), fx.now_lit())


@register("stream_ingest", oracle_for("upsert_index"))
def q_stream_ingest(spark, sf):
    sink, ckpt = sj.run_folder(spark, "ingest")
    docs = ix.map_fields(fx.doc_files_from(table_waves(spark, sf, "documents", "doc_id")))
    changed = docs.where(F.substring(F.col("id"), -1, 1).isin("A", "Q", "g", "w")).select(
        "id", F.concat(F.col("content"), F.lit(" (revised)")).alias("content"), "title", "file_name",
        "file_path", F.timestamp_add("DAY", F.lit(1), F.col("last_modified")).alias("last_modified"), "file_size")
    pages = ix.map_fields(fx.page_files_from(table_waves(spark, sf, "pages", "page_id")))
    q = sj.stream_ingest(docs.unionByName(changed).unionByName(pages), sink, ckpt, map_fn=lambda b: b)
    q.awaitTermination()
    cur = sj.read_current_index(spark, sink)
    return cur.select("id", "file_path", "last_modified", "file_size",
                      F.octet_length("content").cast("bigint").alias("content_bytes"))


@register("stream_stalled_runs", f"""WITH {LATEST_SQL}
SELECT run_id, state, first_ts, last_ts FROM latest
WHERE state NOT IN ('Succeeded', 'Failed', 'Cancelled')
  AND first_ts + INTERVAL 900 SECOND < (SELECT max(ts) FROM status_events WHERE coalesce(status, runStatus) IS NOT NULL)""")
def q_stream_stalled_runs(spark, sf):
    sink, ckpt = sj.run_folder(spark, "stalled")
    q = sj.stream_stalled_runs(fx.status_events_from(event_waves(spark, sf)), sink, ckpt)
    q.awaitTermination()
    return sj.read_stalled_runs(spark, sink, limit_s=900)


# Chosen here: the alarm's query delivers the events in this many waves and waits for two of them.
ALARM_WAVES = 8
_WAIT_MS = f"(SELECT 2 * ((epoch_us(max(ts)) - epoch_us(min(ts))) // {ALARM_WAVES} // 1000 + 1) FROM events)"


@register("stream_run_alarm", f"""WITH {fx.STATUS_SQL},
e AS (SELECT run_id, ts, coalesce(status, runStatus) AS state FROM status_events WHERE coalesce(status, runStatus) IS NOT NULL),
runs AS (SELECT run_id, min(ts) AS first_ts,
                min(ts) FILTER (WHERE state IN ('Succeeded', 'Failed', 'Cancelled')) AS closed FROM e GROUP BY run_id)
SELECT run_id, first_ts, first_ts + INTERVAL 900 SECOND AS due_ts FROM runs
WHERE (closed IS NULL OR closed > first_ts + INTERVAL 900 SECOND)
  AND epoch_us(first_ts) // 1000 + 900000 < (SELECT epoch_us(max(ts)) // 1000 FROM e) - {_WAIT_MS}""")
def q_stream_run_alarm(spark, sf):
    """Alarms that come out of the stream while it runs: the events arrive in eight waves, some a wave
    late, and the watermark waits for two waves."""
    e = fx.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = e.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()  # two numbers
    wait = ((ends["hi"] or 0) - (ends["lo"] or 0)) // ALARM_WAVES // 1000
    sink, ckpt = sj.run_folder(spark, "run-alarm")
    q = sj.stream_run_alarm(fx.status_events_from(event_waves(spark, sf, ALARM_WAVES)), sink, ckpt,
                            delay=f"{2 * (wait + 1)} milliseconds")
    q.awaitTermination()
    return sj.read_run_alarm(spark, sink)


# ------------------------------------------------------------ an index that follows the stream
# Every third document comes twice: as it is and, a day newer, revised.  Some revisions come a wave before
# the document they revise, which must then change nothing.
REVISION = " (revised report 42)"
REVISED_SQL = f"""files AS ({fx.DOC_FILES_SQL}),
old AS ({fx.MAP_FIELDS_SQL}),
docs AS (SELECT id, CASE WHEN r THEN content || '{REVISION}' ELSE content END AS content, title, file_name, file_path,
                CASE WHEN r THEN last_modified + INTERVAL 1 DAY ELSE last_modified END AS last_modified, file_size
         FROM (SELECT *, file_size % 3 = 0 AS r FROM old))"""


def revised_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.docs(spark, sf_dir).withColumn("_wave", (F.col("file_size") % WAVES).cast("int"))
    late = docs.where(F.col("file_size") % 3 == 0).select(
        "id", F.concat(F.col("content"), F.lit(REVISION)).alias("content"), "title", "file_name", "file_path",
        F.timestamp_add("DAY", F.lit(1), F.col("last_modified")).alias("last_modified"), "file_size",
        F.when(F.col("_wave") == WAVES - 1, F.col("_wave") - 1).otherwise(F.col("_wave") + 1).alias("_wave"))
    return waves_of(docs.unionByName(late), F.col("_wave"), "revised").drop("_wave")


def _streamed_index(spark: SparkSession, sf_dir: str) -> str:
    root, ckpt = sj.run_folder(spark, "stream-index")
    si.stream_index(revised_waves(spark, sf_dir), root, ckpt).awaitTermination()
    return root


@register("stream_index_search", search_sql(SEARCH_QUERY, 10, docs_sql=REVISED_SQL))
def q_stream_index_search(spark, sf):
    """Search an index that four waves of documents and revisions have built by signed deltas."""
    return si.search_deltas(spark, _streamed_index(spark, sf), SEARCH_QUERY, k=10)


@register("stream_index_stats", corpus_stats_sql(REVISED_SQL))
def q_stream_index_stats(spark, sf):
    """Document frequencies and lengths as sums over the same deltas."""
    stats = si.delta_corpus_stats(spark, _streamed_index(spark, sf))
    return stats.select("field", "term", "df", "n_docs", F.round("avg_dl", 6).alias("avg_dl"))


# ------------------------------------------------------------ reports of the library's own runs
_OWN_RUNS_SQL = f"""WITH {fx.DOCS_SQL}, {fx.PAGES_SQL.replace('files AS', 'page_files AS').replace('FROM files', 'FROM page_files')},
kept AS (SELECT *, lower(file_name) LIKE '%.png' AS bad FROM docs)
SELECT 'index' AS indexer, 'success' AS last_status, CAST(1 AS BIGINT) AS runs, CAST(count_if(NOT bad) AS BIGINT) AS total_processed,
       CAST(count_if(bad) AS BIGINT) AS total_failed, CAST(coalesce(sum(file_size) FILTER (NOT bad), 0) AS BIGINT) AS total_bytes FROM kept
UNION ALL SELECT 'pages', 'success', CAST({WAVES} AS BIGINT), count(*), CAST(0 AS BIGINT), CAST(coalesce(sum(file_size), 0) AS BIGINT) FROM pagedocs"""


@register("run_report_own", _OWN_RUNS_SQL)
def q_run_report_own(spark, sf):
    """Reports of a batch write that rejects pictures and of a stream of pages, counted while they wrote."""
    base = scratch_path(spark, f"own-runs-{uuid.uuid4().hex[:12]}")
    rp.reported(fx.docs(spark, sf), lambda d: write_index(d, f"{base}/index"), "index", f"{base}/runs",
                rejected=F.lower("file_name").like("%.png"), size=F.col("file_size"))
    pages = fx.table(spark, sf, "pages")
    # a wave, in as many files as it has, is drained before the next: one batch a wave
    for k in range(WAVES):
        pages.where(F.col("page_id") % WAVES == k).write.mode("append").parquet(f"{base}/pages")
        stream = ix.map_fields(fx.page_files_from(spark.readStream.schema(pages.schema).parquet(f"{base}/pages")))
        rp.stream_reported(stream, f"{base}/sink", f"{base}/checkpoint", "pages", f"{base}/runs", size=F.col("file_size")).awaitTermination()
    runs = rp.read_runs(spark, f"{base}/runs")
    total = runs.groupBy("indexer").agg(F.sum("bytes").alias("total_bytes"))
    report = rn.run_report(runs).select("indexer", "last_status", "runs", "total_processed", "total_failed")
    return report.join(total, "indexer")

