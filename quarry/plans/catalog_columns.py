"""Registered queries: projections, predicates and scalar functions as column
jobs over whole tables (SURVEY §2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import names as nm
from ..functions import text as tx
from ..functions import values as vl
from . import fixtures as fx
from .registry import register

NOW_SQL = f"TIMESTAMP '{fx.NOW}'"


def _slug_sql(x: str) -> str:
    s = f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-')"
    return f"nullif(CASE WHEN length({s}) > 128 THEN trim(left({s}, 128), '-') ELSE {s} END, '')"


def _slug_input(spark, sf):
    c = fx.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.concat(F.repeat(F.lit("Ab!"), (F.col("c_custkey") % 50).cast("int")), F.col("c_name"))
                    .alias("raw"))


@register("safe_name", f"""WITH s AS (SELECT c_custkey AS id, repeat('Ab!', CAST(c_custkey % 50 AS INTEGER)) || c_name AS raw FROM customer)
SELECT id, raw, {_slug_sql('raw')} AS slug FROM s""")
def q_safe_name(spark, sf):
    s = _slug_input(spark, sf)
    return s.select("id", "raw", nm.safe_name("raw").alias("slug"))


def _present_sql(x: str) -> str:
    return f"nullif(nullif({x}, ''), 'null')"


@register("scoped_name", f"""WITH {fx.WORKSPACES_SQL},
s AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN '' ELSE displayName END AS ws,
             CASE WHEN id % 8 = 0 THEN NULL ELSE description END AS dm FROM workspaces)
SELECT id, coalesce({_slug_sql(_present_sql('ws') + " || '-documents'")},
                    {_slug_sql(_present_sql('dm') + " || '-documents'")}, '{fm.DEFAULT_INDEX_NAME}') AS index_name
FROM s""")
def q_scoped_name(spark, sf):
    w = fx.workspaces(spark, sf)
    k = F.col("id")
    ws = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("")).otherwise(F.col("displayName"))
    dm = F.when(k % 8 == 0, F.lit(None).cast("string")).otherwise(F.col("description"))
    generic = fm.DEFAULT_INDEX_NAME
    return w.select("id", nm.scoped_name(ws, dm, fm.DOCUMENTS_FOLDER, generic, generic).alias("index_name"))


_KEY = fx.KEY_SQL


@register("document_key", f"""SELECT page_id, {_KEY.format(p='url')} AS key,
       {_KEY.format(p="(url || '/' || url || '/' || url)")} AS long_key,
       CAST(octet_length(encode(url || '/' || url || '/' || url)) AS BIGINT) AS long_bytes
FROM pages""")
def q_document_key(spark, sf):
    p = fx.table(spark, sf, "pages")
    long_url = F.concat_ws("/", "url", "url", "url")
    return p.select("page_id", nm.document_key("url").alias("key"), nm.document_key(long_url).alias("long_key"),
                    nm.utf8_size(long_url).alias("long_bytes"))


@register("path_leaf", """SELECT page_id,
       nullif(list_extract(string_split(url, '/'), -1), '') AS raw_leaf,
       nullif(list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1), '') AS leaf,
       coalesce(nullif(list_extract(string_split(regexp_replace(url, '[^/]*$', ''), '/'), -1), ''), 'documents') AS folder_leaf
FROM pages""")
def q_path_leaf(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", nm.path_leaf("url").alias("raw_leaf"), nm.url_leaf("url").alias("leaf"),
                    nm.path_leaf(F.regexp_replace("url", "[^/]*$", ""), default="documents").alias("folder_leaf"))


RESOURCE_FMT = fm.CAPACITY_RESOURCE_FMT
_RES = RESOURCE_FMT.split("%s")   # literal pieces between the parts, for the SQL twin


@register("compose_id", f"""WITH r AS (
  SELECT c_custkey AS id, 'sub-' || CAST(c_nationkey AS VARCHAR) AS sub,
         CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'rg-' || lower(c_mktsegment) END AS rg,
         'cap' || CAST(c_custkey AS VARCHAR) AS cap FROM customer)
SELECT id, CASE WHEN {_present_sql('sub')} IS NOT NULL AND {_present_sql('rg')} IS NOT NULL AND {_present_sql('cap')} IS NOT NULL
                THEN '{_RES[0]}' || sub || '{_RES[1]}' || rg || '{_RES[2]}' || cap
           END AS resource_id
FROM r""")
def q_compose_id(spark, sf):
    c = fx.table(spark, sf, "customer")
    rg = F.when(F.col("c_custkey") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("rg-"), F.lower("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("id"),
                    nm.compose_id(RESOURCE_FMT, F.concat(F.lit("sub-"), F.col("c_nationkey").cast("string")), rg,
                                  F.concat(F.lit("cap"), F.col("c_custkey").cast("string"))).alias("resource_id"))


@register("path_segment", f"""WITH r AS (
  SELECT c_custkey AS id, '{_RES[0]}sub-' || CAST(c_nationkey AS VARCHAR) || '{_RES[1]}rg-'
         || lower(c_mktsegment) || '{_RES[2]}cap' || CAST(c_custkey AS VARCHAR) AS rid
  FROM customer)
SELECT id, string_split(rid, '/')[5] AS resource_group, string_split(rid, '/')[9] AS capacity,
       string_split(rid, '/')[20] AS beyond FROM r""")
def q_path_segment(spark, sf):
    c = fx.table(spark, sf, "customer")
    rid = F.format_string(RESOURCE_FMT, F.concat(F.lit("sub-"), F.col("c_nationkey").cast("string")),
                          F.concat(F.lit("rg-"), F.lower("c_mktsegment")),
                          F.concat(F.lit("cap"), F.col("c_custkey").cast("string")))
    return c.select(F.col("c_custkey").alias("id"), nm.path_segment(rid, 4).alias("resource_group"),
                    nm.path_segment(rid, 8).alias("capacity"), nm.path_segment(rid, 19).alias("beyond"))


@register("json_path", f"""WITH {fx.OUTPUTS_SQL}
SELECT env, CASE WHEN json_valid(outputs) THEN json_extract_string(outputs, '$.{fm.OUTPUT_CAPACITY_FIELD}.value') END AS capacity_id,
       CASE WHEN json_valid(outputs) THEN json_extract_string(outputs, '$.{fm.OUTPUT_WORKSPACE_FIELD}.value') END AS workspace_name
FROM outputs_json""")
def q_json_path(spark, sf):
    o = fx.outputs_json(spark, sf)
    return o.select("env", vl.json_path("outputs", f"{fm.OUTPUT_CAPACITY_FIELD}.value").alias("capacity_id"),
                    vl.json_path("outputs", f"{fm.OUTPUT_WORKSPACE_FIELD}.value").alias("workspace_name"))


@register("redact_tokens", f"""WITH {fx.MESSAGES_SQL}
SELECT id, regexp_replace(text, '{vl.BEARER_PATTERN}', '{vl.BEARER_MARKER}', 'g') AS text FROM messages""")
def q_redact_tokens(spark, sf):
    m = fx.messages(spark, sf)
    return m.select("id", vl.redact_tokens("text").alias("text"))


@register("excerpt", """SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS excerpt,
       length(text) <= 100 AS short FROM conversations""")
def q_excerpt(spark, sf):
    c = fx.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", nm.excerpt("text", 100).alias("excerpt"),
                    (F.length("text") <= 100).alias("short"))


@register("utf8_size", """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
       CAST(length(text) AS BIGINT) AS chars, n_chars FROM documents""")
def q_utf8_size(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", nm.utf8_size("text").alias("bytes"), F.length("text").cast("bigint").alias("chars"),
                    "n_chars")


_NAMES_LIST = "c_name || ', ,' || c_mktsegment || ' , ' || upper(c_mktsegment) || ','"


@register("split_names", f"""SELECT c_custkey, unnest(list_filter(list_transform(string_split({_NAMES_LIST}, ','), lambda s: trim(s)), lambda s: s <> '')) AS name
FROM customer""")
def q_split_names(spark, sf):
    c = fx.table(spark, sf, "customer")
    lst = F.concat(F.col("c_name"), F.lit(", ,"), F.col("c_mktsegment"), F.lit(" , "), F.upper("c_mktsegment"),
                   F.lit(","))
    return c.select("c_custkey", F.explode(nm.split_names(lst)).alias("name"))


_ALLOWED_SQL = ", ".join(f"'{c}'" for c in nm.CATEGORIES_LAKEHOUSE)


@register("category_of", f"""WITH {fx.DOCS_SQL},
c AS (SELECT nullif(regexp_extract(file_path, 'Files/documents/([^/]+)/', 1), '') AS cat FROM docs)
SELECT CASE WHEN lower(cat) IN ({_ALLOWED_SQL}) THEN cat END AS category, count(*) AS documents FROM c GROUP BY 1""")
def q_category_of(spark, sf):
    d = fx.docs(spark, sf)
    return d.groupBy(nm.category_of(F.col("file_path"), nm.CATEGORIES_LAKEHOUSE).alias("category")) \
        .agg(F.count(F.lit(1)).alias("documents"))


@register("extract_fields", r"""SELECT url, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
       trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'),
                                          '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
       CAST(octet_length(encode(html)) AS BIGINT) AS file_size FROM pages""")
def q_extract_fields(spark, sf):
    """Title and visible text (entities as in the page) and UTF-8 size of every page."""
    p = tx.extract_fields(fx.text_table(spark, sf, "pages"), decode=False)
    return p.select("url", "title", "text", F.col("size").alias("file_size"))


@register("extract_text")
def q_extract_text(spark, sf):
    """Visible page text and title with entities decoded (Arrow-batched pandas UDF)."""
    p = tx.extract_fields(fx.text_table(spark, sf, "pages"), decode=True)
    return p.select("page_id", "text", "title")


def _fp_inputs(spark, sf):
    c = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    c1 = (F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit(""))
          .when(k % 5 == 2, F.lit("null")).when(k % 5 == 3, F.lit("<ws-name>"))
          .otherwise(F.concat(F.lit("explicit-"), k.cast("string"))))
    c2 = (F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, F.lit("<x>"))
          .otherwise(F.col("c_name")))
    return c.select(k.alias("id"), c1.alias("explicit"), c2.alias("from_file"), F.col("c_mktsegment").alias("fallback"))


def _usable_sql(x: str) -> str:
    p = _present_sql(x)
    return f"CASE WHEN NOT regexp_matches({p}, '^<.*>$') THEN {p} END"


@register("first_present", f"""WITH s AS (
  SELECT c_custkey AS id,
         CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN '<ws-name>'
              ELSE 'explicit-' || CAST(c_custkey AS VARCHAR) END AS explicit,
         CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '<x>' ELSE c_name END AS from_file,
         c_mktsegment AS fallback FROM customer)
SELECT id, coalesce({_usable_sql('explicit')}, {_usable_sql('from_file')}, {_usable_sql('fallback')}) AS value FROM s""")
def q_first_present(spark, sf):
    s = _fp_inputs(spark, sf)
    return s.select("id", vl.first_present("explicit", "from_file", "fallback").alias("value"))


@register("age_days", f"""WITH {fx.WORKSPACES_SQL}
SELECT id, date_sub('day', createdDate, {NOW_SQL}) AS age_days FROM workspaces""")
def q_age_days(spark, sf):
    """Whole elapsed days; null where the creation date is unknown."""
    w = fx.workspaces(spark, sf)
    return w.select("id", vl.age_days("createdDate", fx.now_lit()).alias("age_days"))


@register("old_enough", f"""WITH {fx.WORKSPACES_SQL}
SELECT id, coalesce(date_sub('day', createdDate, {NOW_SQL}) >= 7, TRUE) AS old_enough FROM workspaces""")
def q_old_enough(spark, sf):
    """Age check over every workspace; an unknown creation date counts as old enough."""
    w = fx.workspaces(spark, sf)
    return w.select("id", vl.old_enough("createdDate", fx.now_lit(), 7).alias("old_enough"))


CLASSIFY_SQL = """CASE WHEN code >= 200 AND code < 300 THEN 'created'
     WHEN regexp_matches(coalesce(body, ''), '(?i)UnsupportedCapacitySKU') THEN 'unsupported'
     WHEN regexp_matches(coalesce(body, ''), '(?i)ItemDisplayNameAlreadyInUse') OR code = 409 THEN 'present'
     WHEN regexp_matches(coalesce(body, ''), '(?i)NotInActiveState') THEN 'retry'
     WHEN code >= 500 OR code = 429 THEN 'retry' ELSE 'failed' END"""


@register("classify_outcome", f"""WITH {fx.ATTEMPTS_SQL}
SELECT event_id, {CLASSIFY_SQL} AS outcome FROM attempts""")
def q_classify_outcome(spark, sf):
    a = fx.attempts(spark, sf)
    return a.select("event_id", vl.classify_outcome("code", "body").alias("outcome"))


@register("predicates", f"""WITH {fx.WORKSPACES_SQL}
SELECT id, displayName, lower(type) = lower('personal') AS is_personal,
       displayName ILIKE '%#00000001%' AS name_match, coalesce(capacityId IN ('cap-1', 'cap-2', 'cap-3'), FALSE) AS in_list
FROM workspaces
WHERE lower(type) = lower('personal') OR displayName ILIKE '%#00000001%' OR capacityId IN ('cap-1', 'cap-2', 'cap-3')""")
def q_predicates(spark, sf):
    w = fx.workspaces(spark, sf)
    personal = vl.ci_equal("type", F.lit("personal"))
    name_match = vl.ilike_any("displayName", "*#00000001*")
    # like ``-in``: a missing value is simply not in the list
    in_list = F.coalesce(F.col("capacityId").isin("cap-1", "cap-2", "cap-3"), F.lit(False))
    return w.where(personal | name_match | in_list).select(
        "id", "displayName", personal.alias("is_personal"), name_match.alias("name_match"), in_list.alias("in_list"))
