"""Lakehouse layers and path inventories over index rows.

bronze = index rows as scanned; silver = typed, exact duplicates removed,
category and key attached; gold = per-category aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import category_of
from ..functions.text import chunk_count


def silver_documents(docs: DataFrame, allowed=None) -> DataFrame:
    """Exact duplicates (same content hash) removed with a deterministic
    winner (smallest id) and the number of copies; category from the path.

    The winners are picked on (hash, id) alone, combined map-side, and joined
    back: no aggregate holds a text.  Ids are keys of the index (unique)."""
    hashed = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col("content"), F.lit("")), 256))
    win = hashed.groupBy("content_hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return (hashed.join(win, ["id", "content_hash"])
            .select(*docs.columns, "content_hash", "copies")
            .withColumn("category", category_of(F.col("file_path"), allowed)))


def gold_summary(silver: DataFrame) -> DataFrame:
    """Documents, characters, bytes and chunks per category."""
    return silver.groupBy("category").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.length("content")).cast("bigint").alias("characters"),
        F.sum("file_size").cast("bigint").alias("bytes"),
        F.sum(chunk_count(F.col("content"))).cast("bigint").alias("chunks"))


def list_assets(paths: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Recursive listing from file paths: every file plus every parent folder
    (is_dir), distinct.  (path, is_dir, depth)."""
    parts = F.split(F.col(path_col), "/")
    n = F.size(parts)
    folders = paths.select(F.explode(F.sequence(F.lit(1), n - 1)).alias("d"), parts.alias("p")) \
        .select(F.array_join(F.slice("p", 1, F.col("d")), "/").alias("path"),
                F.lit(True).alias("is_dir"), F.col("d").alias("depth"))
    files = paths.select(F.col(path_col).alias("path"), F.lit(False).alias("is_dir"),
                         n.alias("depth"))
    return folders.unionByName(files).distinct()


def asset_counts(assets: DataFrame) -> DataFrame:
    """Folders and files per root folder."""
    root = F.split(F.col("path"), "/").getItem(0)
    return assets.groupBy(root.alias("root")).agg(
        F.count_if("is_dir").alias("folders"), F.count_if(~F.col("is_dir")).alias("files"))


def scope_path(df: DataFrame, prefix: str | None, path_col: str = "file_path") -> DataFrame:
    """Limit to a folder; a null prefix keeps everything."""
    if prefix is None:
        return df
    return df.where(F.col(path_col).startswith(prefix))


def scope_partition(layer: DataFrame, category: str | None, part_col: str = "category") -> DataFrame:
    """Folder scope on a layer written partitioned by category: the predicate
    is on the partition column, so only that folder is listed and read."""
    return layer if category is None else layer.where(F.col(part_col) == F.lit(category))


def newest_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of largest ``order`` per ``key``.  The largest values are found by one aggregate over
    key and order columns and the rows by a join on them, so no aggregate holds the payload and
    rows that lost are not sorted; of rows equal in all of ``order`` one stays."""
    top = rows.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order)).alias("_top"))
    best = rows.join(top, (F.col(key) == F.col("_key")) & (F.struct(*order) == F.col("_top")))
    w = Window.partitionBy("_key").orderBy(*[F.col(c).desc() for c in order])
    return best.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_top", "_n")


def upsert_index(old: DataFrame, new: DataFrame, key: str = "id", version: str = "last_modified") -> DataFrame:
    """Merge keyed on ``key``; the newest ``version`` wins, on a tie the new
    row wins.  Rows of ``old`` whose key the delta lacks pass by an anti join
    on the delta's keys; only keys on both sides are compared, by version."""
    new = newest_rows(new.select(*old.columns), key, [version])
    keys = new.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    joined = old.join(keys, F.col(key) == F.col("_key"), "left")
    stays = joined.where(F.col("_key").isNull() | (F.col(version) > F.col("_version"))).drop("_key", "_version")
    newer = old.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    comes = new.join(newer, (F.col(key) == F.col("_key")) & (F.col(version) < F.col("_version")), "left_anti")
    return stays.unionByName(comes)
