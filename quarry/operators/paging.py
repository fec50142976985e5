"""Keyset paging over a range-sorted copy with stored file bounds.

``write_sorted`` writes the rows in files that follow one another in the order of (value, id), with one row
of bounds a file.  ``page_after`` reads only the files that can hold the next page: those behind the last row
seen, from the first on until they hold enough rows, so page p costs as much as page 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(value: Column, key: Column) -> Column:
    return F.struct(value.alias("value"), key.alias("id"))  # a missing value is the smallest


def write_sorted(df: DataFrame, root: str, value: str, key: str = "id", partitions: int | None = None) -> None:
    """Sorted copy of ``df`` by ``value`` (missing first), then ``key`` (unique), and its file bounds."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(value).asc_nulls_first(), F.col(key).asc()]
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{root}/rows")
    place = _place(F.col(value), F.col(key))
    (spark.read.parquet(f"{root}/rows").groupBy(F.col("_metadata.file_path").alias("file"))
     .agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("rows"))
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/bounds"))


def page_files(spark: SparkSession, root: str, size: int, after: tuple | None = None) -> list[str]:
    """The files that can hold the ``size`` rows behind ``after`` (value, id), in order."""
    bounds = spark.read.parquet(f"{root}/bounds")
    if after is not None:
        kinds = bounds.schema["low"].dataType
        last = _place(*[F.lit(v).cast(f.dataType) for v, f in zip(after, kinds.fields, strict=True)])
        # rows of the file in which the last page ended may all lie before it
        bounds = bounds.where(F.col("high") > last).withColumn("rows", F.when(F.col("low") > last, F.col("rows")).otherwise(0))
    files, held = [], 0
    for row in bounds.orderBy("low").limit(size + 1).collect():  # a file behind the last row holds one at least
        files.append(row["file"])
        held += row["rows"]
        if held >= size:
            break
    return files


def page_after(spark: SparkSession, root: str, value: str, size: int, after: tuple | None = None, key: str = "id") -> DataFrame:
    """The next ``size`` rows behind ``after`` (the last page's last value and key; None: from the start), with
    their position in the page."""
    files = page_files(spark, root, size, after)
    schema = spark.read.parquet(f"{root}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    place = _place(F.col(value), F.col(key))
    if after is not None:
        rows = rows.where(place > _place(*[F.lit(v).cast(schema[c].dataType) for v, c in zip(after, (value, key), strict=True)]))
    from .search import top_k
    return top_k(rows, size, [F.col(value).asc_nulls_first(), F.col(key).asc()]).withColumnRenamed("rank", "position")
