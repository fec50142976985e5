"""Global ranking without a single-partition window.

``row_number() OVER (ORDER BY …)`` moves every row into one task.  Instead:
range-partition and sort within partitions, take the position inside the
partition from ``monotonically_increasing_id`` (partition id in the upper 31
bits, record index in the lower 33), and write the rows with both numbers once.
Counts per partition (one row per partition) and the rows to be ranked then
read that one copy, so that column pruning cannot give them different range
bounds; offsets are joined back as a side bounded by the number of partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], partitions: int | None = None,
                rank_col: str = "rank") -> DataFrame:
    """``df`` with ``rank_col``: 1..n in ``order`` (any payload columns)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    positioned = ordered.select("*", F.shiftright(mid, 33).alias("_part"),
                                mid.bitwiseAND(F.lit(_LOW_BITS)).alias("_pos"))
    path = scratch_path(spark, f"rank-{uuid.uuid4().hex[:12]}")
    positioned.write.parquet(path)
    positioned = spark.read.schema(positioned.schema).parquet(path)
    counts = positioned.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # offsets over at most `n` rows (one per partition)
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    return (positioned.join(F.broadcast(offsets), "_part")
            .withColumn(rank_col, F.col("_offset") + F.col("_pos") + 1)
            .drop("_part", "_pos", "_offset"))
