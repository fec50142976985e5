"""Registered queries: lookups, reconciliation, governance jobs (SURVEY §2.3,
§2.4, §2.7, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formats import DATASOURCE_KIND, OWN_DATASOURCE_PREFIX
from ..operators import governance as gv
from ..operators import lookups as lk
from ..operators import profiles as pf
from ..operators import reconcile as rc
from . import fixtures as fx
from .registry import register

NOW_SQL = f"TIMESTAMP '{fx.NOW}'"


# ------------------------------------------------------------ name resolution
def _resolve_names(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("order-"), k))
                    .otherwise(F.concat(F.lit("LH-"), k)).alias("name"))


def _resolve_listing(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    k = F.col("l_orderkey").cast("string")
    return li.select("l_orderkey").distinct().select(
        F.concat(F.lit("item-"), k).alias("id"), F.concat(F.lit("ORDER-"), k).alias("displayName"),
        F.concat(F.lit("lh-"), k).alias("name"))


RESOLVE_SQL = """rnames AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'order-' || CAST(o_orderkey AS VARCHAR)
                                ELSE 'LH-' || CAST(o_orderkey AS VARCHAR) END AS name FROM orders),
rlisting AS (SELECT DISTINCT 'item-' || CAST(l_orderkey AS VARCHAR) AS id, 'ORDER-' || CAST(l_orderkey AS VARCHAR) AS displayName,
                    'lh-' || CAST(l_orderkey AS VARCHAR) AS name FROM lineitem),
aliases AS (SELECT alias_key, min(id) AS id FROM (
              SELECT lower(displayName) AS alias_key, id FROM rlisting WHERE displayName IS NOT NULL
              UNION ALL SELECT lower(name), id FROM rlisting WHERE name IS NOT NULL) GROUP BY alias_key)"""


@register("resolve_by_name", f"""WITH {RESOLVE_SQL}
SELECT r.name, a.id, a.id IS NOT NULL AS resolved FROM rnames r LEFT JOIN aliases a ON lower(r.name) = a.alias_key""")
def q_resolve_by_name(spark, sf):
    return lk.resolve_by_name(_resolve_names(spark, sf), _resolve_listing(spark, sf))


def _returned_listing(spark, sf):
    li = fx.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    k = F.col("l_orderkey").cast("string")
    return li.select("l_orderkey").distinct().select(
        F.concat(F.lit("returned-"), k).alias("id"), F.concat(F.lit("Order-"), k).alias("displayName"))


@register("resolve_with_fallback", f"""WITH {RESOLVE_SQL},
plist AS (SELECT DISTINCT 'returned-' || CAST(l_orderkey AS VARCHAR) AS id, 'Order-' || CAST(l_orderkey AS VARCHAR) AS displayName
          FROM lineitem WHERE l_returnflag = 'R'),
pa AS (SELECT lower(displayName) AS alias_key, min(id) AS p_id FROM plist GROUP BY 1),
sa AS (SELECT alias_key, id AS s_id FROM aliases)
SELECT r.name, coalesce(p_id, s_id) AS id,
       CASE WHEN p_id IS NOT NULL THEN 'primary' WHEN s_id IS NOT NULL THEN 'secondary' END AS source
FROM rnames r LEFT JOIN pa ON lower(r.name) = pa.alias_key LEFT JOIN sa ON lower(r.name) = sa.alias_key""")
def q_resolve_with_fallback(spark, sf):
    return lk.resolve_with_fallback(_resolve_names(spark, sf), _returned_listing(spark, sf),
                                    _resolve_listing(spark, sf))


# ------------------------------------------------------------ priority choice
def _priority_candidates(spark, sf):
    s = fx.table(spark, sf, "supplier")
    ds = fx.datasources(spark, sf)
    own = s.where(F.col("s_suppkey") % 5 == 0).select(
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.lit(OWN_DATASOURCE_PREFIX.upper())).otherwise(F.lit(OWN_DATASOURCE_PREFIX)),
                 (F.col("s_suppkey") * 3).cast("string")).alias("name"),
        F.lit(DATASOURCE_KIND).alias("kind"), F.concat(F.lit("collection-"), F.col("s_nationkey").cast("string"))
        .alias("collection"), F.col("s_nationkey").alias("workspace"))
    return ds.unionByName(own)


PRIORITY_SQL = f"""{fx.DATASOURCES_SQL},
cands AS (SELECT name, kind, collection FROM datasources
          UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN '{OWN_DATASOURCE_PREFIX.upper()}' ELSE '{OWN_DATASOURCE_PREFIX}' END || CAST(s_suppkey * 3 AS VARCHAR), '{DATASOURCE_KIND}',
                           'collection-' || CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0),
rootf AS (SELECT min(name) AS n FROM cands WHERE lower(kind) = lower('{DATASOURCE_KIND}') AND (coalesce(collection, '') = '' OR lower(collection) = lower('{fx.ACCOUNT_COLLECTION}'))),
anyf AS (SELECT min(name) AS n FROM cands WHERE lower(kind) = lower('{DATASOURCE_KIND}')),
req AS (SELECT c_custkey AS request, '{OWN_DATASOURCE_PREFIX}' || CAST(c_custkey AS VARCHAR) AS own_name FROM customer),
own AS (SELECT lower(name) AS key, min(name) AS own FROM cands GROUP BY 1)"""


@register("pick_by_priority", f"""WITH {PRIORITY_SQL}
SELECT request,
       coalesce(own.own, (SELECT n FROM rootf), (SELECT n FROM anyf), req.own_name) AS datasource,
       CASE WHEN own.own IS NOT NULL THEN 'own'
            WHEN (SELECT n FROM rootf) IS NOT NULL THEN 'root'
            WHEN (SELECT n FROM anyf) IS NOT NULL THEN 'any' ELSE 'create' END AS choice
FROM req LEFT JOIN own ON lower(req.own_name) = own.key""")
def q_pick_by_priority(spark, sf):
    req = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("workspace_id"))
    return lk.pick_by_priority(req, _priority_candidates(spark, sf), fx.ACCOUNT_COLLECTION)


# ------------------------------------------------------------ capacity lookup
LOOKUP_SQL = f"""{fx.WORKSPACES_SQL}, {fx.CAPACITIES_SQL},
act AS (SELECT id AS cap_id, displayName AS cap_name FROM capacities WHERE lower(state) = 'active'),
labelled AS (
  SELECT w.*, CASE WHEN w.capacityId IS NULL THEN 'None' WHEN act.cap_id IS NOT NULL THEN act.cap_name
                   ELSE 'Inactive Capacity (' || CAST(w.capacityId AS VARCHAR) || ')' END AS CapacityInfo,
         act.cap_id IS NOT NULL AS hasActiveCapacity
  FROM workspaces w LEFT JOIN act ON w.capacityId = act.cap_id)"""


@register("lookup_active", f"""WITH {LOOKUP_SQL} SELECT id, displayName, capacityId, CapacityInfo, hasActiveCapacity FROM labelled""")
def q_lookup_active(spark, sf):
    return lk.lookup_active(fx.workspaces(spark, sf), fx.capacities(spark, sf)) \
        .select("id", "displayName", "capacityId", "CapacityInfo", "hasActiveCapacity")


@register("exclude_named", f"""WITH {fx.WORKSPACES_SQL}, {fx.EXCLUDED_SQL}
SELECT * FROM workspaces w WHERE NOT EXISTS (SELECT 1 FROM excluded e WHERE lower(e.name) = lower(w.displayName))""")
def q_exclude_named(spark, sf):
    return lk.exclude_named(fx.workspaces(spark, sf), fx.excluded(spark, sf))


@register("dependents_of", f"""WITH {fx.INDEXERS_SQL}, {fx.DATASOURCES_SQL}
SELECT * FROM indexers WHERE dataSourceName IN (SELECT name FROM datasources WHERE kind = 'AdlsGen2')""")
def q_dependents_of(spark, sf):
    targets = fx.datasources(spark, sf).where(F.col("kind") == "AdlsGen2")
    return lk.dependents_of(fx.indexers(spark, sf), targets)


def _closure_sql(levels: int = 16) -> str:
    """Breadth-first levels written out; more than the references of the tables need."""
    ctes = ["l0 AS (SELECT DISTINCT s_name AS target, s_name AS name, [s_name] AS path FROM supplier WHERE s_suppkey % 5 = 0)"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT target, name FROM l{j}" for j in range(k))
        ctes.append(f"l{k} AS MATERIALIZED (SELECT target, e.name, min(list_append(path, e.name)) AS path FROM l{k - 1} p JOIN edges e "
                    f"ON e.uses = p.name WHERE (target, e.name) NOT IN ({seen}) GROUP BY target, e.name)")
    rows = " UNION ALL ".join(f"SELECT target, name, {k} AS depth, array_to_string(path, ' > ') AS path FROM l{k}" for k in range(1, levels + 1))
    return f"WITH {fx.REFERENCES_SQL}, edges AS (SELECT DISTINCT name, uses FROM refs), {', '.join(ctes)} {rows}"


@register("dependent_closure", _closure_sql())
def q_dependent_closure(spark, sf):
    """All that a replaced data source reaches: indexers, indexes, agents, and round again."""
    targets = fx.table(spark, sf, "supplier").where(F.col("s_suppkey") % 5 == 0).select(F.col("s_name").alias("name"))
    return lk.dependent_closure(fx.references(spark, sf), targets)


@register("scope_filter", f"""WITH {fx.WORKSPACES_SQL}, {fx.SCOPE_SQL}
SELECT o_orderkey AS asset_id, o_custkey AS workspace_id, o_orderstatus AS status FROM orders
WHERE o_custkey IN (SELECT id FROM workspaces WHERE coalesce(type <> 'Personal', TRUE)
                    AND id IN (SELECT workspace_id FROM scope))""")
def q_scope_filter(spark, sf):
    assets = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_id"),
                                                  F.col("o_custkey").alias("workspace_id"),
                                                  F.col("o_orderstatus").alias("status"))
    return lk.scope_filter(assets, fx.scope(spark, sf), fx.workspaces(spark, sf))


@register("first_match", """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
       arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
FROM orders GROUP BY o_custkey""")
def q_first_match(spark, sf):
    o = fx.table(spark, sf, "orders")
    return lk.first_match(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


# ------------------------------------------------------------ reconciliation
@register("missing_grants", f"""WITH {fx.GRANTS_SQL}
SELECT * FROM grants_desired d WHERE NOT EXISTS (
  SELECT 1 FROM grants_actual a WHERE a.principal = d.principal AND a.role = d.role AND a.scope = d.scope)""")
def q_missing_grants(spark, sf):
    return rc.missing_grants(fx.grants_desired(spark, sf), fx.grants_actual(spark, sf))


@register("granted", f"""WITH {fx.GRANTS_SQL}
SELECT * FROM grants_desired d WHERE EXISTS (
  SELECT 1 FROM grants_actual a WHERE a.principal = d.principal AND a.role = d.role AND a.scope = d.scope)""")
def q_granted(spark, sf):
    return rc.granted(fx.grants_desired(spark, sf), fx.grants_actual(spark, sf))


RECONCILE_SQL = f"""{fx.DESIRED_SQL},
ex AS (SELECT lower(name) AS k, min(id) AS id FROM existing GROUP BY 1),
plan AS (SELECT d.name, ex.id, CASE WHEN ex.id IS NOT NULL THEN 'skip' ELSE 'create' END AS action
         FROM desired d LEFT JOIN ex ON lower(d.name) = ex.k)"""


@register("reconcile", f"WITH {RECONCILE_SQL} SELECT * FROM plan")
def q_reconcile(spark, sf):
    return rc.reconcile(fx.desired_items(spark, sf), fx.existing_items(spark, sf))


@register("merge_principals", f"""WITH {fx.PRINCIPALS_SQL},
u AS (SELECT *, 'current' AS origin, 0 AS o FROM p_current UNION ALL SELECT *, 'added' AS origin, 1 AS o FROM p_added)
SELECT scope, id, arg_min(principalType, o) AS principalType, arg_min(origin, o) AS origin FROM u GROUP BY scope, id""")
def q_merge_principals(spark, sf):
    return rc.merge_principals(fx.principals_current(spark, sf), fx.principals_added(spark, sf))


@register("joined_names", """SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY p_name) AS names
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def q_joined_names(spark, sf):
    """Part names per order (a group holds at most seven line items)."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return rc.joined_names(li.join(parts, "l_partkey"), ["l_orderkey"], "p_name")


# ------------------------------------------------------------ orphan report
ORPHAN_SQL = f"""{LOOKUP_SQL}, {fx.EXCLUDED_SQL},
flagged AS (
  SELECT l.*, EXISTS (SELECT 1 FROM excluded e WHERE lower(e.name) = lower(l.displayName)) AS excluded,
         coalesce(date_sub('day', l.createdDate, {NOW_SQL}) >= 7, TRUE) AS old_enough
  FROM labelled l)"""


@register("orphan_report", f"""WITH {ORPHAN_SQL}
SELECT id AS Id, displayName AS Name, type AS Type, CapacityInfo, description AS Description
FROM flagged WHERE NOT excluded AND old_enough AND capacityId IS NULL""")
def q_orphan_report(spark, sf):
    return gv.orphan_report(fx.workspaces(spark, sf), fx.capacities(spark, sf), fx.excluded(spark, sf),
                            fx.now_lit(), 7)


@register("orphan_totals", f"""WITH {ORPHAN_SQL}
SELECT count(*) AS total, (SELECT count(*) FROM excluded) AS exclusion_list,
       CAST(count_if(excluded) AS BIGINT) AS excluded,
       CAST(count_if(NOT excluded AND old_enough AND capacityId IS NULL) AS BIGINT) AS orphans,
       CAST(count_if(capacityId IS NOT NULL AND NOT hasActiveCapacity) AS BIGINT) AS inactive_capacity
FROM flagged""")
def q_orphan_totals(spark, sf):
    return gv.orphan_totals(fx.workspaces(spark, sf), fx.capacities(spark, sf), fx.excluded(spark, sf),
                            fx.now_lit(), 7)


# ------------------------------------------------------------ catalog profile
# the driver's tables and their types, for the twin SQL
PROFILE_SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
PROFILE_TABLES = list(PROFILE_SCHEMAS)


def _profile_sql() -> str:
    parts = []
    for t in PROFILE_TABLES:
        src = (f"(SELECT * FROM orders WHERE o_custkey IN (SELECT id FROM workspaces "
               f"WHERE coalesce(type <> 'Personal', TRUE) AND id IN (SELECT workspace_id FROM scope)))"
               if t == "orders" else t)
        for c, typ in PROFILE_SCHEMAS[t]:
            num = typ in ("int", "bigint", "double")
            lo = f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
            hi = f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
            plain = num or typ.startswith("array")
            ls = "CAST(NULL AS VARCHAR)" if plain else f"CAST(min({c}) AS VARCHAR)"
            hs = "CAST(NULL AS VARCHAR)" if plain else f"CAST(max({c}) AS VARCHAR)"
            parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{typ}' AS type, count(*) AS \"rows\", "
                         f"CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, {lo} AS min_num, {hi} AS max_num, "
                         f"{ls} AS min_str, {hs} AS max_str FROM {src} AS s")
    return f"WITH {fx.WORKSPACES_SQL}, {fx.SCOPE_SQL} " + " UNION ALL ".join(parts)


def _profile_inputs(spark, sf):
    return dict(tables={t: fx.table(spark, sf, t) for t in PROFILE_TABLES},
                scope=fx.scope(spark, sf), workspaces=fx.workspaces(spark, sf),
                workspace_cols={"orders": "o_custkey"})


@register("catalog_scan")
def q_catalog_scan(spark, sf):
    """With approximate distinct counts (HyperLogLog++): rows-only check."""
    return gv.catalog_scan(**_profile_inputs(spark, sf), approx=True)


@register("catalog_profile", _profile_sql())
def q_catalog_profile(spark, sf):
    return gv.catalog_scan(**_profile_inputs(spark, sf), approx=False)


# Chosen here: partition of each profiled table, and the partitions of the merged scope.
STATE_PARTS = {"orders": ("o_orderpriority", ("1-URGENT", "3-MEDIUM", "5-LOW")), "customer": ("c_mktsegment", ("BUILDING", "MACHINERY")),
               "events": ("event_type", ("click", "view", "error"))}


def _states_sql() -> str:
    parts = []
    for t, (part, scope) in STATE_PARTS.items():
        src = f"(SELECT * FROM {t} WHERE {part} IN ({', '.join(repr(v) for v in scope)}))"
        for c, typ in PROFILE_SCHEMAS[t]:
            num = typ in ("int", "bigint", "double")
            plain = num or typ.startswith("array")
            lo, hi = (f"CAST({f}({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)" for f in ("min", "max"))
            ls, hs = ("CAST(NULL AS VARCHAR)" if plain else f"CAST({f}({c}) AS VARCHAR)" for f in ("min", "max"))
            parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{typ}' AS type, count(*) AS \"rows\", "
                         f"CAST(count_if({c} IS NULL) AS BIGINT) AS nulls, {lo} AS min_num, {hi} AS max_num, {ls} AS min_str, "
                         f"{hs} AS max_str, TRUE AS distinct_ok, {'TRUE' if num else 'CAST(NULL AS BOOLEAN)'} AS quartiles_ok FROM {src} AS s")
    return " UNION ALL ".join(parts)


@register("catalog_states", _states_sql())
def q_catalog_states(spark, sf):
    """Profiles stored per partition, merged for a scope of partitions, their estimates held against the
    exact figures of the scope."""
    import uuid
    from ..session import scratch_path
    root = scratch_path(spark, f"profile-states-{uuid.uuid4().hex[:12]}")
    tables, chosen, scoped = {}, F.lit(False), {}
    for t, (part, scope) in STATE_PARTS.items():
        tables[t] = fx.table(spark, sf, t)
        pf.write_states(pf.profile_states(tables[t], t, F.col(part)), root)
        chosen = chosen | ((F.col("table") == t) & F.col("part").isin(list(scope)))
        scoped[t] = tables[t].where(F.col(part).isin(list(scope)))
    merged = pf.merge_states(pf.read_states(spark, root).where(chosen))
    return pf.with_accuracy(merged, scoped).select("table", "column", "type", "rows", "nulls", "min_num", "max_num", "min_str",
                                                   "max_str", "distinct_ok", "quartiles_ok")


# ------------------------------------------------------------ config layers
@register("resolve_config", f"""WITH {fx.CONFIG_SQL},
u AS (SELECT *, CASE WHEN nullif(nullif(value, ''), 'null') IS NOT NULL
                          AND NOT regexp_matches(value, '^<.*>$') THEN value END AS ok FROM config_layers)
SELECT env, key, arg_min(ok, CASE WHEN ok IS NOT NULL THEN priority END) AS value,
       arg_min(layer, CASE WHEN ok IS NOT NULL THEN priority END) AS layer
FROM u GROUP BY env, key""")
def q_resolve_config(spark, sf):
    return gv.resolve_config(fx.config_layers(spark, sf))
