"""Inputs of the registered queries, derived deterministically from the driver
tables (see FIXTURES.md).  Each fixture has a Spark form (DataFrame API) and
a DuckDB SQL twin used by the oracle; both must produce the same rows.

No random values and no ``now()``: the reference instant is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import (CONFIG_KEYS, DATASOURCE_KIND, OUTPUT_CAPACITY_FIELD, OUTPUT_WORKSPACE_FIELD,
                                 PAIR_PREFIX_LAKEHOUSE, TELEMETRY_WORKSPACE_FIELD)
from ..functions.names import url_leaf, utf8_size
from ..functions.text import html_title
from ..operators.index import map_fields

# Chosen here: reference instant, category and extension rotations.
NOW = "2024-02-01 00:00:00"
CATEGORIES = ["contracts", "reports", "policies", "manuals", "presentations"]
EXTENSIONS = ["pdf", "docx", "png", "txt"]
ACCOUNT_COLLECTION = "catalog-account"
LAYERS = ["explicit", "outputs", "envfile", "default"]


def now_lit():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SCAN_PARTITIONS = "quarry.scan.textPartitions"


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows feed CPU-heavy work (tokenizing, HTML).  A session that reads a table kept as
    one row group may set ``quarry.scan.textPartitions`` to deal its rows out; unset, the scan's own
    splits stand."""
    n = spark.conf.get(SCAN_PARTITIONS, None)
    df = table(spark, sf_dir, name)
    return df.repartition(int(n)) if n else df


def _rotate(col, values):
    expr = None
    for i, v in enumerate(values):
        cond = (col % len(values)) == i
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def _sql_rotate(col: str, values) -> str:
    parts = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {col} % {len(values)} {parts} END"


# --------------------------------------------------------------------------
# documents → source files → index rows
# --------------------------------------------------------------------------

def doc_files(spark, sf_dir) -> DataFrame:
    """Source-file view of ``documents`` (content + metadata_* fields)."""
    return doc_files_from(text_table(spark, sf_dir, "documents"))


def doc_files_from(d: DataFrame) -> DataFrame:
    cat = _rotate(F.col("doc_id"), CATEGORIES)
    ext = _rotate(F.col("doc_id"), EXTENSIONS)
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select(
        F.concat(F.lit("Files/documents/"), cat, F.lit("/"), name).alias("metadata_storage_path"),
        name.alias("metadata_storage_name"),
        F.substring_index(F.col("text"), "\n", 1).alias("metadata_title"),
        utf8_size("text").alias("metadata_storage_size"),
        F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("metadata_storage_last_modified"),
        F.col("text").alias("content"),
    )


DOC_FILES_SQL = f"""
SELECT 'Files/documents/' || {_sql_rotate('doc_id', CATEGORIES)} || '/doc-' || CAST(doc_id AS VARCHAR)
         || '.' || {_sql_rotate('doc_id', EXTENSIONS)} AS metadata_storage_path,
       'doc-' || CAST(doc_id AS VARCHAR) || '.' || {_sql_rotate('doc_id', EXTENSIONS)} AS metadata_storage_name,
       split_part(text, chr(10), 1) AS metadata_title,
       CAST(octet_length(encode(text)) AS BIGINT) AS metadata_storage_size,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS metadata_storage_last_modified,
       text AS content
FROM documents"""


def page_files(spark, sf_dir) -> DataFrame:
    """Source-file view of ``pages`` (raw HTML)."""
    return page_files_from(text_table(spark, sf_dir, "pages"))


def page_files_from(p: DataFrame) -> DataFrame:
    return p.select(
        F.col("url").alias("metadata_storage_path"),
        url_leaf("url").alias("metadata_storage_name"),
        html_title("html").alias("metadata_title"),
        utf8_size("html").alias("metadata_storage_size"),
        F.timestamp_add("MINUTE", F.col("page_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
        .alias("metadata_storage_last_modified"),
        F.col("html").alias("content"),
    )


PAGE_FILES_SQL = r"""
SELECT url AS metadata_storage_path,
       nullif(list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1), '') AS metadata_storage_name,
       nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS metadata_title,
       CAST(octet_length(encode(html)) AS BIGINT) AS metadata_storage_size,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id AS BIGINT)) AS metadata_storage_last_modified,
       html AS content
FROM pages"""


def docs(spark, sf_dir) -> DataFrame:
    """Index rows (the seven declared fields) for ``documents``."""
    return map_fields(doc_files(spark, sf_dir))


# SQL twin of map_fields over a files CTE named ``files``.
KEY_SQL = "rtrim(translate(to_base64(encode({p})), '+/', '-_'), '=')"
MAP_FIELDS_SQL = f"""
SELECT {KEY_SQL.format(p='metadata_storage_path')} AS id,
       content, metadata_title AS title, metadata_storage_name AS file_name,
       metadata_storage_path AS file_path, metadata_storage_last_modified AS last_modified,
       metadata_storage_size AS file_size
FROM files"""

DOCS_SQL = f"files AS ({DOC_FILES_SQL}), docs AS ({MAP_FIELDS_SQL})"
PAGES_SQL = f"files AS ({PAGE_FILES_SQL}), pagedocs AS ({MAP_FIELDS_SQL})"


def queries_table(spark, sf_dir) -> DataFrame:
    """Batch of questions: the whole text of each ``benchmark`` item."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


# --------------------------------------------------------------------------
# governance inventories
# --------------------------------------------------------------------------

def workspaces(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    created = F.timestamp_add("MINUTE", F.lit(-30),
                              F.timestamp_add("DAY", -(k % 20), now_lit()))
    return c.select(
        k.alias("id"),
        F.when(k % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("displayName"),
        F.when(k % 11 == 0, F.lit("Personal")).otherwise(F.lit("Workspace")).alias("type"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("cap-"), F.col("c_nationkey").cast("string"))).alias("capacityId"),
        F.when(k % 7 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(created).alias("createdDate"),
        F.col("c_mktsegment").alias("description"),
    )


WORKSPACES_SQL = f"""workspaces AS (
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS displayName,
       CASE WHEN c_custkey % 11 = 0 THEN 'Personal' ELSE 'Workspace' END AS type,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'cap-' || CAST(c_nationkey AS VARCHAR) END AS capacityId,
       CASE WHEN c_custkey % 7 = 0 THEN NULL
            ELSE TIMESTAMP '{NOW}' - to_days(CAST(c_custkey % 20 AS INTEGER)) - INTERVAL 30 MINUTE END AS createdDate,
       c_mktsegment AS description
FROM customer)"""


def capacities(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("cap-"), F.col("n_nationkey").cast("string")).alias("id"),
        F.col("n_name").alias("displayName"),
        F.lower("n_name").alias("name"),
        F.when(F.col("n_regionkey") < 3, F.lit("Active")).otherwise(F.lit("Paused")).alias("state"),
        F.concat(F.lit("F"), ((F.col("n_regionkey") + 1) * 8).cast("string")).alias("sku"),
    )


CAPACITIES_SQL = """capacities AS (
SELECT 'cap-' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS displayName, lower(n_name) AS name,
       CASE WHEN n_regionkey < 3 THEN 'Active' ELSE 'Paused' END AS state,
       'F' || CAST((n_regionkey + 1) * 8 AS VARCHAR) AS sku
FROM nation)"""


def excluded(spark, sf_dir) -> DataFrame:
    """Exclusion list: every 50th customer name, lower-cased (tests case folding)."""
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_custkey") % 50 == 0).select(F.lower("c_name").alias("name"))


EXCLUDED_SQL = "excluded AS (SELECT lower(c_name) AS name FROM customer WHERE c_custkey % 50 = 0)"


def scope(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_nationkey") < 5).select(F.col("c_custkey").alias("workspace_id"))


SCOPE_SQL = "scope AS (SELECT c_custkey AS workspace_id FROM customer WHERE c_nationkey < 5)"


def datasources(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("name"),
        F.when(k % 4 == 0, F.lit(DATASOURCE_KIND.lower())).when(k % 2 == 0, F.lit(DATASOURCE_KIND))
        .otherwise(F.lit("AdlsGen2")).alias("kind"),
        F.when(k % 12 == 0, F.lit(None).cast("string")).when(k % 12 == 6, F.lit(""))
        .when(k % 6 == 2, F.lit(ACCOUNT_COLLECTION.upper()))
        .otherwise(F.concat(F.lit("collection-"), F.col("s_nationkey").cast("string"))).alias("collection"),
        F.col("s_nationkey").alias("workspace"),
    )


DATASOURCES_SQL = f"""datasources AS (
SELECT s_name AS name,
       CASE WHEN s_suppkey % 4 = 0 THEN '{DATASOURCE_KIND.lower()}' WHEN s_suppkey % 2 = 0 THEN '{DATASOURCE_KIND}'
            ELSE 'AdlsGen2' END AS kind,
       CASE WHEN s_suppkey % 12 = 0 THEN NULL WHEN s_suppkey % 12 = 6 THEN ''
            WHEN s_suppkey % 6 = 2 THEN '{ACCOUNT_COLLECTION.upper()}'
            ELSE 'collection-' || CAST(s_nationkey AS VARCHAR) END AS collection,
       s_nationkey AS workspace
FROM supplier)"""


def indexers(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("indexer-"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 100 + 1).cast("string"), 9, "0"))
        .alias("dataSourceName"),
        F.concat(F.lit("index-"), F.lower(F.col("p_brand"))).alias("targetIndexName"),
    )


INDEXERS_SQL = """indexers AS (
SELECT 'indexer-' || CAST(p_partkey AS VARCHAR) AS name,
       'Supplier#' || lpad(CAST(p_partkey % 100 + 1 AS VARCHAR), 9, '0') AS dataSourceName,
       'index-' || lower(p_brand) AS targetIndexName
FROM part)"""


def references(spark, sf_dir) -> DataFrame:
    """What uses what: indexers use data sources, indexes indexers, agents indexes, and the indexes of
    large parts agents again (cycles)."""
    p = table(spark, sf_dir, "part")
    indexer = F.concat(F.lit("indexer-"), F.col("p_partkey").cast("string"))
    index = F.concat(F.lit("index-"), F.lower("p_brand"))
    agent = F.concat(F.lit("agent-"), F.lower("p_type"))
    pairs = F.array(
        F.struct(indexer.alias("name"), F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 100 + 1).cast("string"), 9, "0")).alias("uses")),
        F.struct(index.alias("name"), F.when(F.col("p_partkey") % 40 == 0, indexer).alias("uses")),
        F.struct(agent.alias("name"), F.when(F.col("p_partkey") % 9 == 0, index).alias("uses")),
        F.struct(index.alias("name"), F.when(F.col("p_size") == 50, agent).alias("uses")))
    return p.select(F.inline(pairs)).where("uses is not null")


REFERENCES_SQL = """refs AS (
SELECT 'indexer-' || p_partkey AS name, 'Supplier#' || lpad(CAST(p_partkey % 100 + 1 AS VARCHAR), 9, '0') AS uses FROM part
UNION ALL SELECT 'index-' || lower(p_brand), 'indexer-' || p_partkey FROM part WHERE p_partkey % 40 = 0
UNION ALL SELECT 'agent-' || lower(p_type), 'index-' || lower(p_brand) FROM part WHERE p_partkey % 9 = 0
UNION ALL SELECT 'index-' || lower(p_brand), 'agent-' || lower(p_type) FROM part WHERE p_size = 50)"""


def desired_items(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"))


def existing_items(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey").distinct().select(
        F.concat(F.lit("ORDER-"), F.col("l_orderkey").cast("string")).alias("name"),
        F.concat(F.lit("item-"), F.col("l_orderkey").cast("string")).alias("id"))


DESIRED_SQL = """desired AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS name FROM orders),
existing AS (SELECT DISTINCT 'ORDER-' || CAST(l_orderkey AS VARCHAR) AS name, 'item-' || CAST(l_orderkey AS VARCHAR) AS id FROM lineitem)"""


def grants_desired(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("principal"), F.col("o_orderpriority").alias("role"),
                    F.col("o_orderstatus").alias("scope")).distinct()


def grants_actual(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderdate") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("principal"), F.col("o_orderpriority").alias("role"),
        F.col("o_orderstatus").alias("scope")).distinct()


GRANTS_SQL = """grants_desired AS (SELECT DISTINCT o_custkey AS principal, o_orderpriority AS role, o_orderstatus AS scope FROM orders),
grants_actual AS (SELECT DISTINCT o_custkey AS principal, o_orderpriority AS role, o_orderstatus AS scope
                  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00')"""


def principals_current(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("scope"),
                    F.col("c_custkey").alias("id"), F.lit("User").alias("principalType"))


def principals_added(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("scope"),
                    F.col("s_suppkey").alias("id"), F.lit("ServicePrincipal").alias("principalType"))


PRINCIPALS_SQL = """p_current AS (SELECT 'nation-' || CAST(c_nationkey AS VARCHAR) AS scope, c_custkey AS id, 'User' AS principalType FROM customer),
p_added AS (SELECT 'nation-' || CAST(s_nationkey AS VARCHAR) AS scope, s_suppkey AS id, 'ServicePrincipal' AS principalType FROM supplier)"""


# --------------------------------------------------------------------------
# run telemetry
# --------------------------------------------------------------------------

def _k(props):
    return F.get_json_object(props, "$.k").cast("bigint")


def runs(spark, sf_dir) -> DataFrame:
    return runs_from(table(spark, sf_dir, "events"))


def runs_from(e: DataFrame) -> DataFrame:
    et = F.col("event_type")
    return e.select(
        F.col("user_id").alias("indexer"),
        F.col("event_id").alias("run_id"),
        F.when(et == "click", F.lit("transientFailure")).when(et == "error", F.lit("error"))
        .otherwise(F.lit("success")).alias("status"),
        F.col("ts").alias("start"),
        F.timestamp_add("MICROSECOND", F.round(F.col("value") * 1000000).cast("bigint"), F.col("ts")).alias("end"),
        F.floor("value").cast("int").alias("itemsProcessed"),
        (_k(F.col("props")) % 3).cast("int").alias("itemsFailed"),
        F.when(et == "error", F.concat(F.lit("error in run "), F.col("event_id").cast("string")))
        .alias("errorMessage"),
        # one entry a failed item; a run that failed transiently warns
        F.transform(F.filter(F.sequence(F.lit(1), F.lit(2)), lambda i: i <= _k(F.col("props")) % 3), lambda i: F.struct(
            F.concat(F.lit("item-"), i.cast("string")).alias("key"),
            F.concat(F.lit("failed in run "), F.col("event_id").cast("string")).alias("message"))).alias("errors"),
        F.filter(F.array(F.when(et == "click", F.struct(
            F.lit("run").alias("key"),
            F.concat(F.lit("transient in run "), F.col("event_id").cast("string")).alias("message")))),
            lambda w: w.isNotNull()).alias("warnings"),
    )


RUNS_SQL = """runs AS (
SELECT user_id AS indexer, event_id AS run_id,
       CASE WHEN event_type = 'click' THEN 'transientFailure' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       ts AS start,
       ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS "end",
       CAST(floor(value) AS INTEGER) AS itemsProcessed,
       CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS INTEGER) AS itemsFailed,
       CASE WHEN event_type = 'error' THEN 'error in run ' || CAST(event_id AS VARCHAR) END AS errorMessage,
       array_to_string(list_transform(range(1, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1),
                                      lambda i: 'item-' || i || ': failed in run ' || event_id), '; ') AS errors,
       CASE WHEN event_type = 'click' THEN 'run: transient in run ' || event_id ELSE '' END AS warnings,
       CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS n_errors,
       CAST(event_type = 'click' AS BIGINT) AS n_warnings
FROM events)"""


def _status_of(et):
    return (F.when(et == "purchase", F.lit("Succeeded")).when(et == "error", F.lit("Failed"))
            .when(et == "signup", F.lit("Queued")).otherwise(F.lit("Running")))


def status_events(spark, sf_dir) -> DataFrame:
    return status_events_from(table(spark, sf_dir, "events"))


def status_events_from(e: DataFrame) -> DataFrame:
    st = _status_of(F.col("event_type"))
    even = F.col("event_id") % 2 == 0
    return e.select(
        F.expr("event_id div 4").alias("run_id"),
        F.col("event_id"),
        F.col("ts"),
        F.when(even, st).alias("status"),
        F.when(~even, st).alias("runStatus"),
    )


_STATUS_CASE = ("CASE WHEN event_type = 'purchase' THEN 'Succeeded' WHEN event_type = 'error' THEN 'Failed' "
                "WHEN event_type = 'signup' THEN 'Queued' ELSE 'Running' END")
STATUS_SQL = f"""status_events AS (
SELECT event_id // 4 AS run_id, event_id, ts,
       CASE WHEN event_id % 2 = 0 THEN {_STATUS_CASE} END AS status,
       CASE WHEN event_id % 2 = 1 THEN {_STATUS_CASE} END AS runStatus
FROM events)"""


def attempts(spark, sf_dir) -> DataFrame:
    return attempts_from(table(spark, sf_dir, "events"))


def attempts_from(e: DataFrame) -> DataFrame:
    et = F.col("event_type")
    even = F.col("event_id") % 2 == 0
    sku = (_k(F.col("props")) % 10) == 0
    code = (F.when(et == "purchase", F.lit(201)).when(et == "view", F.lit(429))
            .when((et == "click") & even, F.lit(503))
            .when((et == "error") & ~sku, F.lit(400)).otherwise(F.lit(None).cast("int")))
    body = (F.when(et == "purchase", F.lit("{\"id\": \"ok\"}"))
            .when(et == "signup", F.lit("ItemDisplayNameAlreadyInUse"))
            .when(et == "view", F.lit("TooManyRequests"))
            .when((et == "click") & even, F.lit("ServiceUnavailable"))
            .when(et == "click", F.lit("NotInActiveState"))
            .when(sku, F.lit("UnsupportedCapacitySKU"))
            .otherwise(F.lit("BadRequest")))
    return e.select(F.expr("event_id div 8").alias("item"), "event_id", "ts",
                    code.alias("code"), body.alias("body"))


ATTEMPTS_SQL = """attempts AS (
SELECT event_id // 8 AS item, event_id, ts,
       CASE WHEN event_type = 'purchase' THEN 201 WHEN event_type = 'view' THEN 429
            WHEN event_type = 'click' AND event_id % 2 = 0 THEN 503
            WHEN event_type = 'error' AND NOT (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0) THEN 400
            ELSE NULL END AS code,
       CASE WHEN event_type = 'purchase' THEN '{"id": "ok"}'
            WHEN event_type = 'signup' THEN 'ItemDisplayNameAlreadyInUse'
            WHEN event_type = 'view' THEN 'TooManyRequests'
            WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'ServiceUnavailable'
            WHEN event_type = 'click' THEN 'NotInActiveState'
            WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN 'UnsupportedCapacitySKU'
            ELSE 'BadRequest' END AS body
FROM events)"""


def telemetry(spark, sf_dir) -> DataFrame:
    return telemetry_from(table(spark, sf_dir, "events"))


def telemetry_from(e: DataFrame) -> DataFrame:
    return e.select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("RunId"),
        F.col("event_type").alias("Workflow"),
        _status_of(F.col("event_type")).alias("Status"),
        F.floor("value").cast("int").alias("Duration"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts"))
        .alias("Timestamp"),
        F.col("user_id").alias(TELEMETRY_WORKSPACE_FIELD),
    )


TELEMETRY_SQL = f"""telemetry AS (
SELECT 'run-' || CAST(event_id AS VARCHAR) AS RunId, event_type AS Workflow, {_STATUS_CASE} AS Status,
       CAST(floor(value) AS INTEGER) AS Duration,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS "Timestamp",
       user_id AS {TELEMETRY_WORKSPACE_FIELD}
FROM events)"""


# --------------------------------------------------------------------------
# configuration
# --------------------------------------------------------------------------

def config_layers(spark, sf_dir) -> DataFrame:
    """customer × keys × layers; value missing, empty, 'null' or a placeholder
    by (custkey + key index + priority) mod 6."""
    # twelve rows come out of every customer: customers are dealt out before, by the key that the layers
    # are resolved by, or all of them come out of the few tasks that read the table
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(n, "c_custkey")
    keys = F.array(*[F.struct(F.lit(i).alias("ki"), F.lit(k).alias("key")) for i, k in enumerate(CONFIG_KEYS)])
    layers = F.array(*[F.struct(F.lit(i + 1).alias("priority"), F.lit(l).alias("layer"))
                       for i, l in enumerate(LAYERS)])
    x = (c.select("c_custkey", "c_name", F.inline(keys))
         .select("*", F.inline(layers)))
    sel = (F.col("c_custkey") + F.col("ki") + F.col("priority")) % 6
    value = (F.when(sel == 0, F.lit(None).cast("string")).when(sel == 1, F.lit(""))
             .when(sel == 2, F.lit("null")).when(sel == 3, F.lit("<your-value>"))
             .otherwise(F.concat_ws("-", F.col("layer"), F.col("key"), F.col("c_name"))))
    return x.select(F.col("c_custkey").alias("env"), "key", "layer", F.col("priority").cast("int"),
                    value.alias("value"))


def _sql_values(rows):
    return ", ".join("(" + ", ".join(rows_i) + ")" for rows_i in rows)


CONFIG_SQL = f"""cfg_keys(ki, key) AS (VALUES {_sql_values([(str(i), f"'{k}'") for i, k in enumerate(CONFIG_KEYS)])}),
cfg_layers(priority, layer) AS (VALUES {_sql_values([(str(i + 1), f"'{l}'") for i, l in enumerate(LAYERS)])}),
config_layers AS (
SELECT c_custkey AS env, key, layer, CAST(priority AS INTEGER) AS priority,
       CASE (c_custkey + ki + priority) % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null'
            WHEN 3 THEN '<your-value>' ELSE concat_ws('-', layer, key, c_name) END AS value
FROM customer, cfg_keys, cfg_layers)"""


def outputs_json(spark, sf_dir) -> DataFrame:
    """Deployment-output JSON strings per customer; every 17th is malformed and
    every 4th lacks the capacity entry."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    cap_key = F.when(k % 4 == 0, F.lit("otherId")).otherwise(F.lit(OUTPUT_CAPACITY_FIELD))
    body = F.concat(F.lit('{"'), cap_key, F.lit('":{"value":"cap-'), k.cast("string"),
                    F.lit(f'"}},"{OUTPUT_WORKSPACE_FIELD}":{{"value":"'), F.col("c_name"), F.lit('"}'))
    js = F.when(k % 17 == 0, body).otherwise(F.concat(body, F.lit("}")))
    return c.select(k.alias("env"), js.alias("outputs"))


OUTPUTS_SQL = f"""outputs_json AS (
SELECT c_custkey AS env,
       '{{"' || CASE WHEN c_custkey % 4 = 0 THEN 'otherId' ELSE '{OUTPUT_CAPACITY_FIELD}' END || '":{{"value":"cap-'
         || CAST(c_custkey AS VARCHAR) || '"}},"{OUTPUT_WORKSPACE_FIELD}":{{"value":"' || c_name || '"}}'
         || CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '}}' END AS outputs
FROM customer)"""


def pair_lines(spark, sf_dir) -> DataFrame:
    """KEY="value" lines (keys repeated, values containing '=', every fifth without its closing
    quote), numbered, in eight files."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    key = F.concat(F.lit(PAIR_PREFIX_LAKEHOUSE + "_"), (k % 97).cast("string"), F.lit("_ID"))
    line = F.concat(key, F.lit('="'), F.col("c_name"), F.lit("=v"), k.cast("string"),
                    F.when(k % 5 == 0, F.lit("")).otherwise(F.lit('"')))
    return c.select((k * 2).alias("line_no"), line.alias("line"), (k % 8).alias("file"))


PAIR_LINES_SQL = f"""pair_lines AS (
SELECT c_custkey * 2 AS line_no,
       '{PAIR_PREFIX_LAKEHOUSE}_' || CAST(c_custkey % 97 AS VARCHAR) || '_ID="' || c_name || '=v' || CAST(c_custkey AS VARCHAR)
       || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '"' END AS line, c_custkey % 8 AS file
FROM customer)"""


def messages(spark, sf_dir) -> DataFrame:
    """Conversation turns with a bearer token appended to even turns."""
    cv = table(spark, sf_dir, "conversations")
    word = F.when(F.col("conv_id") % 2 == 0, F.lit("Bearer ")).otherwise(F.lit("bearer "))
    tok = F.concat(word, F.lit("tok"), F.col("conv_id").cast("string"), F.lit(".a-b_c~d+e/f=="))
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit(" Authorization: "), tok)) \
        .otherwise(F.col("text"))
    return cv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text.alias("text"))


MESSAGES_SQL = """messages AS (
SELECT conv_id * 1000 + turn AS id,
       CASE WHEN turn % 2 = 0 THEN text || ' Authorization: '
              || CASE WHEN conv_id % 2 = 0 THEN 'Bearer ' ELSE 'bearer ' END
              || 'tok' || CAST(conv_id AS VARCHAR) || '.a-b_c~d+e/f=='
            ELSE text END AS text
FROM conversations)"""


def listing_envelopes(spark, sf_dir) -> DataFrame:
    """One ``{"value": [...]}`` listing document per order, packed with
    to_json: the items are the order's line items (at most seven per order by
    the TPC-H schema), so each collected group is bounded while the number of
    documents grows with the data."""
    li = table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").cast("string").alias("id"),
                    F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("displayName"))
    return (li.groupBy(F.col("l_orderkey").alias("page"))
            .agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("value"))).alias("json")))


def mixed_listings(spark, sf_dir) -> DataFrame:
    """(page, json): listings of the line items of an order, in an envelope that differs from order to order
    (value, data, items, a bare array, a single object); every 23rd is cut short."""
    li = table(spark, sf_dir, "lineitem")
    n, part = F.col("l_linenumber").cast("string"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    odd = F.col("l_linenumber") % 2 == 1
    item = F.struct(F.when(odd, n).alias("id"), F.when(~odd, n).alias("objectId"), F.when(odd, part).alias("displayName"),
                    F.when(~odd, part).alias("name"))
    pages = li.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("part"), item.alias("item")))).alias("all"))  # at most seven a page
    items = F.transform("all", lambda x: x["item"])
    shape = F.col("page") % 5
    body = (F.when(shape == 0, F.to_json(F.struct(items.alias("value")))).when(shape == 1, F.to_json(F.struct(items.alias("data"))))
            .when(shape == 2, F.to_json(F.struct(F.lit("page").alias("kind"), items.alias("items"))))
            .when(shape == 3, F.to_json(items)).otherwise(F.to_json(items[0])))
    return pages.select("page", F.when(F.col("page") % 23 == 0, F.expr("'{\"value\": [{\"id\"'")).otherwise(body).alias("json"))


MIXED_LISTINGS_SQL = """placed AS (
SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS position,
       CAST(l_linenumber AS VARCHAR) AS id, 'part-' || l_partkey AS name FROM lineitem),
listed AS (
SELECT page, position, id, name, FALSE AS broken FROM placed WHERE page % 23 <> 0 AND (page % 5 <> 4 OR position = 0)
UNION ALL SELECT DISTINCT l_orderkey, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), TRUE FROM lineitem WHERE l_orderkey % 23 = 0)"""
