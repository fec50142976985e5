"""A search index that follows arriving documents: postings as signed deltas.

Every micro-batch appends to four folders, one sub-folder a batch (``batch_id=<n>``):

  rows      the index rows it accepted (newest version per key; a tie goes to the later batch), with the
            batch of the row that each replaces, the names of its fields that have a value and its terms
  postings  +1 postings of the accepted rows, -1 postings of the rows they replace, both from the terms
            stored with the rows, so no text is read or tokenized again and no stored posting moves
  terms     the changes of document frequency and occurrences of every term
  stats     the changes of documents, values and length of every field

Document frequencies, lengths and averages are sums over deltas; a posting counts where its signs sum to
one.  A batch reads only batches before it (keys and versions of all, terms of those that hold a replaced
row) and overwrites its own folders, so a batch that is delivered again changes nothing.  ``compact_index``
folds all deltas into the layout of a built index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import SEARCHABLE, TERMS, build_postings, postings_of_terms, with_terms
from ..operators.lake import newest_rows
from ..operators.search import query_term_list, rank_postings
from ..sources.sinks import write_postings
from .jobs import _start

_KEY, _VERSION = "id", "last_modified"
# Chosen here: bytes of rows that a task makes postings of; it sorts them in memory.
TASK_BYTES = 16 * 1024 * 1024
_SPLIT = "spark.sql.files.maxPartitionBytes"


def _version(col: Column) -> Column:
    return F.struct(col)  # a missing version is the oldest


def _accepted(batch: DataFrame, prior: DataFrame) -> DataFrame:
    """The batch's newest rows that are not older than what is there, with the batch they replace."""
    new = newest_rows(batch, _KEY, [_VERSION])
    there = (prior.select(F.col(_KEY).alias("_key"), _VERSION, "batch_id")
             .join(new.select(F.col(_KEY).alias("_key")), "_key", "left_semi")
             .groupBy("_key").agg(F.max(F.struct(_VERSION, "batch_id")).alias("_there")))
    joined = new.join(there, F.col(_KEY) == F.col("_key"), "left")
    wins = F.col("_there").isNull() | (_version(F.col(_VERSION)) >= _version(F.col(f"_there.{_VERSION}")))
    return joined.where(wins).withColumn("replaces", F.col("_there.batch_id").cast("long")).drop("_key", "_there")


def _fields_held(fields: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())


def _before(df: DataFrame, batch_id: int) -> DataFrame:
    return df.where(F.col("batch_id") < batch_id)


def _write(df: DataFrame, path: str) -> None:
    """Overwrite a folder, in row groups that a task can take one of."""
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", TASK_BYTES).parquet(path)


def _write_batch(batch: DataFrame, batch_id: int, root: str, fields: list[str]) -> None:
    spark = batch.sparkSession
    split = spark.conf.get(_SPLIT)
    spark.conf.set(_SPLIT, str(TASK_BYTES))
    try:
        _write_deltas(batch, batch_id, root, fields)
    finally:
        spark.conf.set(_SPLIT, split)


def _write_deltas(batch: DataFrame, batch_id: int, root: str, fields: list[str]) -> None:
    spark, here = batch.sparkSession, f"batch_id={batch_id}"
    prior = _before(spark.read.parquet(f"{root}/rows"), batch_id)
    accepted = with_terms(_accepted(batch, prior).withColumn("held", _fields_held(fields)), fields)
    _write(accepted, f"{root}/rows/{here}")
    accepted = spark.read.schema(accepted.schema).parquet(f"{root}/rows/{here}")
    gone = accepted.where("replaces is not null").select(_KEY, F.col("replaces").alias("batch_id"))
    held_in = [r["batch_id"] for r in gone.select("batch_id").distinct().collect()]  # a number a folder: only these are read
    replaced = prior.where(F.col("batch_id").isin(held_in)).join(gone, [_KEY, "batch_id"], "left_semi")
    plus = build_postings(accepted, fields, unique=True).withColumn("sign", F.lit(1))
    minus = postings_of_terms(replaced).withColumn("sign", F.lit(-1))
    _write(plus.unionByName(minus).sortWithinPartitions("field", "term"), f"{root}/postings/{here}")
    postings = spark.read.schema(plus.schema).parquet(f"{root}/postings/{here}")
    terms = postings.groupBy("field", "term").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("cf"))
    _write(terms, f"{root}/terms/{here}")
    old = replaced.select("held").withColumn("sign", F.lit(-1))
    rows = accepted.select("held").withColumn("sign", F.lit(1)).unionByName(old)
    # one row a field: its documents, those with a value, and its length
    counts = rows.agg(F.sum("sign").alias("n_docs"), *[F.sum(F.col("sign") * F.array_contains("held", f).cast("int")).alias(f)
                                                       for f in fields])
    args = ", ".join(f"'{f}', `{f}`" for f in fields)
    per_field = counts.select(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.expr(f"stack({len(fields)}, {args}) AS (field, present)"))
    lengths = spark.read.schema(terms.schema).parquet(f"{root}/terms/{here}").groupBy("field").agg(F.sum("cf").alias("length"))
    (per_field.join(lengths, "field", "left")
     .select("field", "n_docs", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("length", F.lit(0)).alias("length"))
     .write.mode("overwrite").parquet(f"{root}/stats/{here}"))


def stream_index(docs: DataFrame, root: str, checkpoint: str, fields=SEARCHABLE, trigger: str | None = None):
    """Keep the index under ``root`` up to date with a stream of index rows."""
    fields, spark = list(fields), docs.sparkSession
    empty = spark.createDataFrame([], docs.schema)
    rows = with_terms(empty.withColumn("replaces", F.lit(None).cast("long")).withColumn("held", _fields_held(fields)), fields)
    postings = build_postings(empty, fields, unique=True).withColumn("sign", F.lit(1))
    stats = spark.createDataFrame([], "field string, n_docs long, present long, length long")
    terms = spark.createDataFrame([], "field string, term string, df long, cf long")
    # readers find schemas before the first batch
    for name, df in (("rows", rows), ("postings", postings), ("stats", stats), ("terms", terms)):
        spark.createDataFrame([], df.schema).write.mode("append").parquet(f"{root}/{name}/batch_id=-1")
    return _start(docs.writeStream.foreachBatch(lambda batch, n: _write_batch(batch, n, root, fields))
                  .option("checkpointLocation", checkpoint), trigger)


def read_index_rows(spark: SparkSession, root: str) -> DataFrame:
    """The current index rows: the newest accepted row per key."""
    return newest_rows(spark.read.parquet(f"{root}/rows"), _KEY, [_VERSION, "batch_id"]).drop("batch_id", "replaces", "held", TERMS)


def delta_postings(postings: DataFrame) -> DataFrame:
    """(field, term, id, dl, tf): the postings whose signs sum to one."""
    return (postings.groupBy("field", "term", "id", "dl", "tf").agg(F.sum("sign").alias("sign"))
            .where("sign > 0").drop("sign"))


def delta_terms(spark: SparkSession, root: str) -> DataFrame:
    """(field, term, df, cf) over all batches; terms that no document holds any more are left out."""
    return (spark.read.parquet(f"{root}/terms").groupBy("field", "term")
            .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0"))


def delta_stats(spark: SparkSession, root: str) -> DataFrame:
    """(field, n_docs, avg_dl) over all batches."""
    sums = spark.read.parquet(f"{root}/stats").groupBy("field").agg(*[F.sum(c).alias(c) for c in ("n_docs", "present", "length")])
    return sums.select("field", "n_docs", F.when(F.col("present") > 0, F.col("length") / F.col("present")).alias("avg_dl"))


def delta_corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    """(field, term, df, n_docs, avg_dl), as :func:`quarry.operators.index.corpus_stats` of the current rows."""
    return delta_terms(spark, root).drop("cf").join(F.broadcast(delta_stats(spark, root)), "field")  # one row per field


def search_deltas(spark: SparkSession, root: str, query: str, k: int = 5, fields=SEARCHABLE) -> DataFrame:
    """BM25 top-k over the deltas: same scores and ranking as a search over a rebuilt index.  Only the
    query terms' postings and frequencies are read."""
    terms = query_term_list(spark, query)
    mine = F.col("field").isin(list(fields)) & F.col("term").isin(terms)
    post = delta_postings(spark.read.parquet(f"{root}/postings").where(mine))
    dfreq = delta_terms(spark, root).where(mine).select("field", "term", "df")
    return rank_postings(post, dfreq, delta_stats(spark, root), k)


def compact_index(spark: SparkSession, root: str, target: str, partitions: int | None = None) -> None:
    """Fold the deltas into a built index (``postings``, ``terms``, ``stats``) that ``search_index`` reads."""
    write_postings(delta_postings(spark.read.parquet(f"{root}/postings")), f"{target}/postings", partitions)
    delta_terms(spark, root).sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{target}/terms")
    delta_stats(spark, root).write.mode("overwrite").parquet(f"{target}/stats")
