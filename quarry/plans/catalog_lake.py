"""Registered queries: lakehouse layers, path inventories, key=value and
listing sources, exports and index upserts (SURVEY §2.1, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formats import PAIR_PREFIX_LAKEHOUSE
from ..operators import index as ix
from ..operators import lake as lk
from ..sources import files as sf_files
from ..sources import sinks
from . import fixtures as fx
from .registry import register

SILVER_SQL = f"""{fx.DOCS_SQL},
silver AS (
  SELECT arg_min(id, id) AS id, arg_min(content, id) AS content, arg_min(title, id) AS title,
         arg_min(file_name, id) AS file_name, arg_min(file_path, id) AS file_path,
         arg_min(last_modified, id) AS last_modified, arg_min(file_size, id) AS file_size,
         sha256(coalesce(content, '')) AS content_hash, count(*) AS copies,
         nullif(regexp_extract(arg_min(file_path, id), 'Files/documents/([^/]+)/', 1), '') AS category
  FROM docs GROUP BY sha256(coalesce(content, '')))"""


@register("silver_documents", f"""WITH {SILVER_SQL}
SELECT id, title, file_name, file_path, last_modified, file_size, content_hash, copies, category FROM silver""")
def q_silver_documents(spark, sf):
    return lk.silver_documents(fx.docs(spark, sf)).drop("content")


def _chunks_sql(x: str) -> str:
    return f"CASE WHEN length(coalesce({x}, '')) <= 2000 THEN 1 ELSE CAST(ceil((length({x}) - 2000) / 1800.0) AS INTEGER) + 1 END"


@register("gold_summary", f"""WITH {SILVER_SQL}
SELECT category, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS characters,
       CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum({_chunks_sql('content')}) AS BIGINT) AS chunks
FROM silver GROUP BY category""")
def q_gold_summary(spark, sf):
    return lk.gold_summary(lk.silver_documents(fx.docs(spark, sf)))


ASSETS_SQL = f"""{fx.DOCS_SQL},
parts AS (SELECT file_path, string_split(file_path, '/') AS p FROM docs),
assets AS (
  SELECT DISTINCT array_to_string(list_slice(p, 1, d), '/') AS path, TRUE AS is_dir, CAST(d AS INTEGER) AS depth
  FROM (SELECT p, unnest(range(1, len(p))) AS d FROM parts)
  UNION SELECT file_path, FALSE, CAST(len(p) AS INTEGER) FROM parts)"""


@register("list_assets", f"WITH {ASSETS_SQL} SELECT * FROM assets")
def q_list_assets(spark, sf):
    return lk.list_assets(fx.docs(spark, sf))


@register("asset_counts", f"""WITH {ASSETS_SQL}
SELECT string_split(path, '/')[1] AS root, CAST(count_if(is_dir) AS BIGINT) AS folders,
       CAST(count_if(NOT is_dir) AS BIGINT) AS files FROM assets GROUP BY 1""")
def q_asset_counts(spark, sf):
    return lk.asset_counts(lk.list_assets(fx.docs(spark, sf)))


@register("scope_path", f"""WITH {fx.DOCS_SQL}
SELECT id, file_path, file_size FROM docs WHERE starts_with(file_path, 'Files/documents/reports/')""")
def q_scope_path(spark, sf):
    d = lk.scope_path(fx.docs(spark, sf), "Files/documents/reports/")
    return d.select("id", "file_path", "file_size")


@register("scan_documents_filter", f"""WITH {fx.DOCS_SQL}
SELECT id, file_name FROM docs
WHERE (lower(file_path) LIKE '%.pdf' OR lower(file_path) LIKE '%.docx')
  AND NOT (lower(file_path) LIKE '%.png' OR lower(file_path) LIKE '%.jpeg')""")
def q_scan_documents_filter(spark, sf):
    """The scan's include/exclude rule applied to the document paths."""
    d = fx.docs(spark, sf)
    return d.where(sf_files.extension_filter("file_path")).select("id", "file_name")


def _updates(spark, sf):
    """A later delivery: every third document re-sent a day later with new
    content, plus the pages as new documents."""
    d = fx.docs(spark, sf)
    changed = d.where(F.substring(F.col("id"), -1, 1).isin("A", "Q", "g", "w")).select(
        "id", F.concat(F.col("content"), F.lit(" (revised)")).alias("content"), "title", "file_name", "file_path",
        F.timestamp_add("DAY", F.lit(1), F.col("last_modified")).alias("last_modified"), "file_size")
    return changed.unionByName(ix.map_fields(fx.page_files(spark, sf)))


@register("upsert_index", f"""WITH {fx.DOCS_SQL}, {fx.PAGES_SQL.replace('files AS', 'pfiles AS').replace('FROM files', 'FROM pfiles')},
upd AS (SELECT id, content || ' (revised)' AS content, title, file_name, file_path, last_modified + INTERVAL 1 DAY AS last_modified, file_size
        FROM docs WHERE right(id, 1) IN ('A', 'Q', 'g', 'w')
        UNION ALL SELECT * FROM pagedocs),
u AS (SELECT *, 0 AS src FROM docs UNION ALL SELECT *, 1 AS src FROM upd)
SELECT id, arg_max(file_path, (last_modified, src)) AS file_path, max(last_modified) AS last_modified,
       arg_max(file_size, (last_modified, src)) AS file_size,
       arg_max(octet_length(encode(content)), (last_modified, src)) AS content_bytes
FROM u GROUP BY id""")
def q_upsert_index(spark, sf):
    merged = lk.upsert_index(fx.docs(spark, sf), _updates(spark, sf))
    return merged.select("id", "file_path", "last_modified", "file_size",
                         F.octet_length("content").cast("bigint").alias("content_bytes"))


def _pairs_sql(pick: str) -> str:
    return f"""WITH {fx.PAIR_LINES_SQL},
m AS (SELECT file, line_no, trim(regexp_extract(line, '{sf_files.PAIR_PATTERN}', 1)) AS key,
             trim(trim(regexp_extract(line, '{sf_files.PAIR_PATTERN}', 2)), '"') AS value
      FROM pair_lines WHERE regexp_matches(line, '{sf_files.PAIR_PATTERN}'))
SELECT file, key, {pick}(value, line_no) AS value FROM m GROUP BY file, key"""


def _scan_pairs(spark, sf, keep):
    """The lines written as eight files, read back by the file scan."""
    path = _scratch(spark, "pair-files")
    (fx.pair_lines(spark, sf).repartition(8, "file").sortWithinPartitions("file", "line_no")
     .select("line", "file").write.partitionBy("file").text(path))
    found = sf_files.scan_pairs(spark, path, keep=keep)
    return found.withColumn("file", F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long"))


@register("scan_pairs", _pairs_sql("arg_max"))
def q_scan_pairs(spark, sf):
    return _scan_pairs(spark, sf, "last")


@register("scan_pairs_first", _pairs_sql("arg_min"))
def q_scan_pairs_first(spark, sf):
    return _scan_pairs(spark, sf, "first")


@register("scan_listing", """SELECT CAST(l_linenumber AS VARCHAR) AS id,
       'part-' || CAST(l_partkey AS VARCHAR) AS displayName FROM lineitem""")
def q_scan_listing(spark, sf):
    """Listing documents written as JSON lines, read back by the file scan."""
    path = _scratch(spark, "listings")
    fx.listing_envelopes(spark, sf).select("json").write.text(path)
    return sf_files.scan_listing(spark, path, wholetext=False)


@register("scan_variants", f"""WITH {fx.MIXED_LISTINGS_SQL} SELECT page, position, id, name, broken FROM listed""")
def q_scan_variants(spark, sf):
    """Listings of five shapes, some cut short: parsed once, stored, read by path."""
    path = _scratch(spark, "variants")
    sf_files.parse_variants(fx.mixed_listings(spark, sf)).write.parquet(path)
    return sf_files.variant_items(spark.read.parquet(path), keep_cols=["page"])


# the first supplier stands for the default layer
LAKEHOUSE_DEFAULT = "bronze"
EXPORT_SQL = f"""lakehouses AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey = 1 THEN '{LAKEHOUSE_DEFAULT}' ELSE s_name END AS name
                FROM supplier),
pairs AS (SELECT '{PAIR_PREFIX_LAKEHOUSE}_' || name || '_ID=' || CAST(id AS VARCHAR) AS line FROM lakehouses
          UNION ALL SELECT '{PAIR_PREFIX_LAKEHOUSE}_ID=' || CAST(id AS VARCHAR) FROM lakehouses WHERE name = '{LAKEHOUSE_DEFAULT}')"""


def _lakehouses(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") == 1, F.lit(LAKEHOUSE_DEFAULT))
                    .otherwise(F.col("s_name")).alias("name"))


@register("export_pairs", f"WITH {EXPORT_SQL} SELECT line FROM pairs")
def q_export_pairs(spark, sf):
    return sinks.pair_lines(_lakehouses(spark, sf), PAIR_PREFIX_LAKEHOUSE, "name", "id", LAKEHOUSE_DEFAULT)


# ------------------------------------------------------------ SQL functions
@register("sql_functions", f"""WITH {fx.DOCS_SQL},
n AS (SELECT id, title, content,
             CASE WHEN length(content) <= 2000 THEN 1 ELSE CAST(ceil((length(content) - 2000) / 1800.0) AS INTEGER) + 1 END AS cnt
      FROM docs)
SELECT id, nullif(CASE WHEN length(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-')) > 128
                       THEN trim(left(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-'), 128), '-')
                       ELSE trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') END, '') AS slug,
       CAST(p AS INTEGER) AS chunk_no, CAST(length(substring(content, p * 1800 + 1, 2000)) AS INTEGER) AS chunk_len
FROM n, range(0, cnt) AS r(p)""")
def q_sql_functions(spark, sf):
    """The SQL-registered functions used from SQL: a scalar slug and a
    lateral table function producing chunks."""
    from ..functions.sql import register_sql_functions
    register_sql_functions(spark)
    fx.docs(spark, sf).createOrReplaceTempView("quarry_docs")
    return spark.sql("""SELECT d.id, safe_name(d.title) AS slug, c.chunk_no, length(c.chunk) AS chunk_len
                        FROM quarry_docs d, LATERAL chunk_text(d.content) c""")


# ------------------------------------------------------------ sinks, read back
def _scratch(spark, name):
    import uuid
    from ..session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("write_index", f"WITH {fx.DOCS_SQL} SELECT * FROM docs")
def q_write_index(spark, sf):
    path = _scratch(spark, "index")
    sinks.write_index(fx.docs(spark, sf), path)
    return spark.read.parquet(path)


@register("write_layers", f"""WITH {SILVER_SQL}
SELECT category, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS characters,
       CAST(sum(file_size) AS BIGINT) AS bytes, CAST(sum({_chunks_sql('content')}) AS BIGINT) AS chunks
FROM silver GROUP BY category""")
def q_write_layers(spark, sf):
    paths = sinks.write_layers(fx.docs(spark, sf), _scratch(spark, "lake"))
    gold = spark.read.parquet(paths["gold"])
    return gold.select("category", "documents", "characters", "bytes", "chunks")


@register("export_pairs_file", f"WITH {EXPORT_SQL} SELECT line AS value FROM pairs")
def q_export_pairs_file(spark, sf):
    path = _scratch(spark, "pairs")
    sinks.export_pairs(_lakehouses(spark, sf), path, PAIR_PREFIX_LAKEHOUSE, "name", "id", default=LAKEHOUSE_DEFAULT)
    return spark.read.text(path)


@register("scope_partition", f"""WITH {fx.DOCS_SQL}
SELECT id, file_path, file_size FROM docs WHERE starts_with(file_path, 'Files/documents/reports/')""")
def q_scope_partition(spark, sf):
    """Scope by folder on the bronze layer (partitioned by category): partition pruning."""
    path = _scratch(spark, "bronze")
    sinks.write_bronze(fx.docs(spark, sf), path)
    bronze = spark.read.parquet(path)
    return lk.scope_partition(bronze, "reports").select("id", "file_path", "file_size")
