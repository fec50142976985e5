"""Written intermediate tables and Arrow batch bounds shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows (long texts), unless the session already
    sets its own bound."""
    if spark.conf.get(ARROW_BYTES, None) in (None, str(2**31 - 1)):
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and gives later passes one stable copy."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(col, n: int):
    """crc32 of an id's decimal text, modulo ``n``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)
