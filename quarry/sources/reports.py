"""Run reports of the library's own jobs, counted in the pass that writes.

``Observation`` metrics ride on the rows as they are written: rows kept, rows rejected and bytes come out of
the write itself, without a second scan.  A run is a row of the schema that ``run_report`` reads, appended to
a folder of runs; a run that fails is reported as an error before its exception goes on.  A stream reports a
run a micro-batch, in a folder of the batch's number, so that a batch delivered again replaces its report.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..streaming.jobs import _start

RUN_SCHEMA = ("indexer string, run_id string, status string, start timestamp_ntz, end timestamp_ntz, itemsProcessed long, "
              "itemsFailed long, bytes long, errorMessage string, errors array<struct<key:string,message:string>>, "
              "warnings array<struct<key:string,message:string>>")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def observed(df: DataFrame, rejected: Column | None = None, size: Column | None = None) -> tuple[DataFrame, Observation]:
    """The rows to write and what is counted while they are: kept, rejected, bytes."""
    bad = F.coalesce(rejected, F.lit(False)) if rejected is not None else F.lit(False)
    size = F.lit(0) if size is None else size
    seen = Observation()
    marked = df.withColumn("_rejected", bad)
    counted = marked.observe(seen, F.count_if(~F.col("_rejected")).alias("kept"), F.count_if("_rejected").alias("rejected"),
                             F.coalesce(F.sum(F.when(~F.col("_rejected"), size)), F.lit(0)).cast("long").alias("bytes"))
    return counted.where(~F.col("_rejected")).drop("_rejected"), seen


def _run(job: str, run_id: str, start: dt.datetime, seen: Observation | None, error: str | None = None) -> tuple:
    got = seen.get if seen is not None else {"kept": 0, "rejected": 0, "bytes": 0}
    warnings = [("run", f"{got['rejected']} rows rejected")] if got["rejected"] else []
    return (job, run_id, "success" if error is None else "error", start, _now(), got["kept"], got["rejected"], got["bytes"], error,
            [("run", error)] if error else [], warnings)


def reported(df: DataFrame, write: Callable[[DataFrame], None], job: str, runs: str, rejected: Column | None = None,
             size: Column | None = None, folder: str | None = None) -> None:
    """Write ``df`` without its rejected rows by ``write`` (one action) and append the run to ``runs``."""
    spark, start, run_id = df.sparkSession, _now(), uuid.uuid4().hex
    rows, seen = observed(df, rejected, size)
    path = f"{runs}/run={folder or run_id}"

    def tell(run: tuple) -> None:
        spark.createDataFrame([run], RUN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    try:
        write(rows)
    except Exception as exc:
        tell(_run(job, run_id, start, None, f"{type(exc).__name__}: {str(exc)[:500]}"))
        raise
    tell(_run(job, run_id, start, seen))


def stream_reported(rows: DataFrame, sink: str, checkpoint: str, job: str, runs: str, rejected: Column | None = None,
                    size: Column | None = None, trigger: str | None = None):
    """Append a stream to ``sink``, a folder and a reported run a micro-batch."""
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(f"{sink}/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        reported(batch, lambda b: b.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}"), job, runs, rejected, size,
                 folder=f"{job}-{batch_id}")
    return _start(rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), trigger)


def read_runs(spark: SparkSession, runs: str) -> DataFrame:
    """All reported runs, for ``run_report`` and ``last_n_runs``."""
    return spark.read.schema(RUN_SCHEMA).parquet(runs)
