"""Filters as bitmaps over document ordinals.

``write_filtered_index`` numbers the documents (1..n by id) and stores, next to postings that carry the
number, one bitmap per (filter field, value, bucket of 32,768 documents); a missing value is a value of
its own, so each document stands in exactly one bitmap of every field.  A condition is evaluated on
bitmaps alone (``bitmap_or_agg`` over the values that a leaf accepts, ``bitmap_and_agg`` /
``bitmap_or_agg`` over its parts, a negation moved to the leaves, where it accepts the other values), and
the query's postings are tested by bit before they are scored: no document row or text is read.

Filter fields should have few values beside the documents (extension, folder, hour); a bitmap takes 4 KB a
bucket whatever it holds.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import global_rank
from .index import SEARCHABLE
from .search import query_term_list, rank_postings, write_search_index


@dataclass(frozen=True)
class Has:
    """Documents whose value of ``field`` (as text, column ``value``) meets ``test``; missing values and
    unknown results do not."""
    field: str
    test: Column
    negated: bool = False

    def __invert__(self) -> Has:
        return replace(self, negated=not self.negated)


@dataclass(frozen=True)
class Both:
    """Documents that meet all conditions."""
    parts: tuple

    def __invert__(self) -> Either:
        return Either(tuple(~p for p in self.parts))


@dataclass(frozen=True)
class Either:
    """Documents that meet any condition."""
    parts: tuple

    def __invert__(self) -> Both:
        return Both(tuple(~p for p in self.parts))


def write_filtered_index(docs: DataFrame, root: str, filters: dict[str, Column], fields=SEARCHABLE,
                         partitions: int | None = None) -> None:
    """A search index with document numbers in its postings, and bitmaps of the ``filters`` columns."""
    numbered = global_rank(docs.select("id", *[c.cast("string").alias(f) for f, c in filters.items()]), [F.asc("id")],
                           rank_col="ord")
    write_search_index(docs, root, fields, partitions, numbers=numbered.select("id", "ord"))
    args = ", ".join(f"'{f}', `{f}`" for f in filters)
    values = numbered.select("ord", F.expr(f"stack({len(filters)}, {args}) AS (field, value)"))
    bitmaps = (values.groupBy("field", "value", F.bitmap_bucket_number("ord").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("ord")).alias("bits")))
    bitmaps.repartition("field").sortWithinPartitions("value", "bucket").write.mode("overwrite") \
        .partitionBy("field").parquet(f"{root}/bitmaps")


def matching(spark: SparkSession, root: str, where: Has | Both | Either) -> DataFrame:
    """(bucket, bits) of the documents that meet a condition; buckets without any may be missing."""
    if isinstance(where, Has):
        test = F.coalesce(where.test, F.lit(False))
        leaf = spark.read.parquet(f"{root}/bitmaps").where((F.col("field") == where.field) & (~test if where.negated else test))
        return leaf.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = reduce(DataFrame.unionByName, [matching(spark, root, p) for p in where.parts]).groupBy("bucket")
    if isinstance(where, Either):
        return both.agg(F.bitmap_or_agg("bits").alias("bits"))
    return (both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(where.parts)).drop("n"))


def bit_set(bits: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is 1."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.bit_get(byte.cast("int"), (position % 8).cast("int")) == 1


def count_matching(spark: SparkSession, root: str, where: Has | Both | Either) -> DataFrame:
    """(documents): how many documents meet a condition, from bitmaps alone."""
    return matching(spark, root, where).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("documents"))


def search_matching(spark: SparkSession, root: str, query: str, where: Has | Both | Either, k: int = 5,
                    fields=SEARCHABLE) -> DataFrame:
    """BM25 top-k among the documents that meet a condition; statistics stay global over the index."""
    terms = query_term_list(spark, query)
    mine = F.col("term").isin(terms)
    post = (spark.read.parquet(f"{root}/postings").where(F.col("field").isin(list(fields)) & mine)
            .withColumn("bucket", F.bitmap_bucket_number("ord")))
    post = (post.join(matching(spark, root, where), "bucket")
            .where(bit_set(F.col("bits"), F.bitmap_bit_position("ord"))).drop("bucket", "bits", "ord"))
    dfreq = spark.read.parquet(f"{root}/terms").where(mine).select("field", "term", "df")
    return rank_postings(post, dfreq, spark.read.parquet(f"{root}/stats"), k)
