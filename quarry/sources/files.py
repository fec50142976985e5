"""File scans: documents, key=value files, JSON listings, path inventories.

Scans use Spark's file sources (``binaryFile``, ``text``, ``json``) with the
hidden ``_metadata`` struct for file facts; filters on names and folders are
plain predicates so they can prune files before reading content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import path_leaf

# Extensions the indexer includes and excludes.
INCLUDE_EXTENSIONS = [".pdf", ".docx"]
EXCLUDE_EXTENSIONS = [".png", ".jpeg"]


def extension_filter(path_col, include=INCLUDE_EXTENSIONS, exclude=EXCLUDE_EXTENSIONS):
    """Case-insensitive extension test; exclusion wins when both match."""
    p = F.lower(F.col(path_col) if isinstance(path_col, str) else path_col)
    inc = None
    for e in include or []:
        c = p.endswith(e.lower())
        inc = c if inc is None else (inc | c)
    exc = None
    for e in exclude or []:
        c = p.endswith(e.lower())
        exc = c if exc is None else (exc | c)
    cond = inc if inc is not None else F.lit(True)
    if exc is not None:
        cond = cond & ~exc
    return cond


def scan_documents(spark: SparkSession, root: str, include=INCLUDE_EXTENSIONS,
                   exclude=EXCLUDE_EXTENSIONS, as_text: bool = False) -> DataFrame:
    """Recursive scan → source-file rows (content + metadata_* fields).

    ``pathGlobFilter`` prunes by extension, in any letter case, at listing
    time when inclusions are given; the predicate on the path applies the
    full include/exclude rule.  ``content`` is the raw bytes, or with
    ``as_text`` their UTF-8 text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if include:
        globs = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))
                         for e in sorted(include))
        reader = reader.option("pathGlobFilter", f"*.{{{globs}}}")
    raw = reader.load(root)
    keep = extension_filter(F.col("path"), include, exclude)
    content = F.decode(F.col("content"), "UTF-8") if as_text else F.col("content")
    return raw.where(keep).select(
        F.col("path").alias("metadata_storage_path"),
        path_leaf(F.col("path")).alias("metadata_storage_name"),
        F.regexp_replace(path_leaf(F.col("path")), r"\.[^.]*$", "").alias("metadata_title"),
        F.col("length").alias("metadata_storage_size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("metadata_storage_last_modified"),
        content.alias("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text file(s) → (file, line_no, line), one row per line, split across
    tasks like any text scan.  ``line_no`` is an order key, not a count:
    (start of the file split, position within the split), which is monotone
    in file order — all that first/last-wins needs."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("pos")).alias("line_no"),
        F.col("value").alias("line"))


# key=value rule — split at the first '=', strip double quotes.
PAIR_PATTERN = r"^(.+?)=(.*)$"


def parse_pairs(lines: DataFrame, keep: str = "last", line_col: str = "line",
                order_col: str = "line_no", group_cols=()) -> DataFrame:
    """KEY=VALUE lines → (key, value, line_no): blank and key-less lines are
    dropped, double quotes at either end stripped, duplicates resolved by
    ``keep`` = "last" | "first" with an aggregate (max_by / min_by)."""
    line = F.col(line_col)
    m = lines.where(line.rlike(PAIR_PATTERN)).select(
        *group_cols, F.col(order_col).alias("line_no"),
        F.trim(F.regexp_extract(line, PAIR_PATTERN, 1)).alias("key"),
        F.btrim(F.trim(F.regexp_extract(line, PAIR_PATTERN, 2)), F.lit('"')).alias("value"))
    pick = F.max_by if keep == "last" else F.min_by
    return (m.groupBy(*group_cols, "key")
            .agg(pick(F.struct("value", "line_no"), F.col("line_no")).alias("_p"))
            .select(*group_cols, "key", F.col("_p.value").alias("value"), F.col("_p.line_no").alias("line_no")))


def scan_pairs(spark: SparkSession, path: str, keep: str = "last") -> DataFrame:
    """(file, key, value) from KEY=VALUE files."""
    return parse_pairs(read_lines(spark, path), keep=keep, group_cols=("file",)).drop("line_no")


LISTING_ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("displayName", T.StringType())])


def parse_listing(docs: DataFrame, json_col: str = "json", envelope: str = "value",
                  item_schema: T.StructType = LISTING_ITEM, keep_cols=()) -> DataFrame:
    """``{envelope: [...]}`` JSON documents → one row per item; a missing
    envelope gives zero rows."""
    schema = T.StructType([T.StructField(envelope, T.ArrayType(item_schema))])
    parsed = docs.select(*keep_cols, F.from_json(F.col(json_col), schema).alias("_j"))
    return parsed.select(*keep_cols, F.inline(F.coalesce(F.col(f"_j.{envelope}"),
                                                         F.array().cast(T.ArrayType(item_schema)))))


def scan_listing(spark: SparkSession, path: str, envelope: str = "value",
                 item_schema: T.StructType = LISTING_ITEM, wholetext: bool = True) -> DataFrame:
    """Items of the listing documents under ``path``: one a file, or one a line."""
    raw = spark.read.text(path, wholetext=wholetext).select(F.col("value").alias("json"))
    return parse_listing(raw, "json", envelope, item_schema)


# ------------------------------------------------------------ listings of any shape
# The names under which listings hold their items, in order of preference, and an item's id and name.
ENVELOPES = ("value", "data", "items")
ID_NAMES = ("id", "objectId")
DISPLAY_NAMES = ("displayName", "name")


def parse_variants(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """``raw`` with ``doc`` (a VARIANT, parsed once) in place of the text, and ``broken``: whether there was
    text that is no JSON.  Written as Parquet, it is read by path without parsing again."""
    text = F.col(json_col)
    doc = F.try_parse_json(text)
    return raw.withColumn("doc", doc).withColumn("broken", F.col("doc").isNull() & text.isNotNull()).drop(json_col)


def variant_field(v: Column, names) -> Column:
    """The first of some fields that an item has, as text."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])


def variant_items(parsed: DataFrame, keep_cols=(), envelopes=ENVELOPES) -> DataFrame:
    """(keep_cols, position, id, name, broken): one row per item of every listing, whatever holds the items:
    an object with one of the ``envelopes``, a bare array, or a single object that has an id.  A listing
    without items gives no row, a broken document one row without an item."""
    bare = F.try_variant_get("doc", "$", "array<variant>")
    held = [F.try_variant_get("doc", f"$.{e}", "array<variant>") for e in envelopes]
    single = F.when(variant_field(F.col("doc"), ID_NAMES).isNotNull(), F.array(F.col("doc")))
    items = F.coalesce(bare, *held, single, F.when(F.col("broken"), F.array(F.lit(None).cast("variant"))))
    out = parsed.select(*keep_cols, "broken", F.posexplode(items).alias("position", "item"))
    return out.select(*keep_cols, F.when(~F.col("broken"), F.col("position")).alias("position"),
                      variant_field(F.col("item"), ID_NAMES).alias("id"), variant_field(F.col("item"), DISPLAY_NAMES).alias("name"), "broken")


def variant_schema(parsed: DataFrame) -> DataFrame:
    """(documents, broken, schema): what the listings hold, as one merged schema."""
    return parsed.agg(F.count(F.lit(1)).alias("documents"), F.count_if("broken").alias("broken"),
                      F.schema_of_variant_agg("doc").alias("schema"))
