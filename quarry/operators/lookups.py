"""Lookups over resource listings: name resolution, fallback, priority choice,
active-capacity labels, exclusions, dependants and scope.

The scripts loop and look up one object at a time; here each loop is one
equi/semi/anti join.  Listings carry no broadcast hint: adaptive execution
broadcasts them only when their measured size is below the threshold, and
keeps a shuffle join (with skew splitting) otherwise.
Case-insensitive matching is the default (``case_sensitive=True`` gives the
exact comparison of the bash variants).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import DATASOURCE_KIND, OWN_DATASOURCE_PREFIX
from ..session import scratch_path


def _fold(c: Column, case_sensitive: bool) -> Column:
    return c if case_sensitive else F.lower(c)


def listing_aliases(listing: DataFrame, alias_cols=("displayName", "name"), id_col: str = "id",
                    case_sensitive: bool = False) -> DataFrame:
    """(alias_key, id): every alias of every listed object, first id per alias
    (lowest id; the service order is not defined).  An aggregate, so a
    duplicated alias never gathers its rows in one task."""
    cols = [c for c in alias_cols if c in listing.columns]
    args = ", ".join(f"`{c}`" for c in cols)
    long = listing.select(F.col(id_col).alias("_id"),
                          F.expr(f"explode(array({args}))").alias("_alias"))
    return (long.where(F.col("_alias").isNotNull())
            .groupBy(_fold(F.col("_alias"), case_sensitive).alias("alias_key"))
            .agg(F.min("_id").alias("id")))


def resolve_by_name(names: DataFrame, listing: DataFrame, name_col: str = "name",
                    alias_cols=("displayName", "name"), case_sensitive: bool = False) -> DataFrame:
    """names ⋈ listing where displayName OR name matches — as a union of
    aliases and one equi join, never an OR join condition.  Unresolved names
    are kept with a null id.  (name, id, resolved)."""
    aliases = listing_aliases(listing, alias_cols, case_sensitive=case_sensitive)
    keyed = names.select(F.col(name_col).alias("name"),
                         _fold(F.col(name_col), case_sensitive).alias("alias_key"))
    return (keyed.join(aliases, "alias_key", "left")
            .select("name", "id", F.col("id").isNotNull().alias("resolved")))


def resolve_with_fallback(names: DataFrame, primary: DataFrame, secondary: DataFrame,
                          name_col: str = "name", alias_cols=("displayName", "name"),
                          case_sensitive: bool = False) -> DataFrame:
    """Try the primary listing; only for names it misses, the secondary one.
    (name, id, source) with source null when both miss."""
    p = listing_aliases(primary, alias_cols, case_sensitive=case_sensitive) \
        .withColumnRenamed("id", "p_id")
    s = listing_aliases(secondary, alias_cols, case_sensitive=case_sensitive) \
        .withColumnRenamed("id", "s_id")
    keyed = names.select(F.col(name_col).alias("name"),
                         _fold(F.col(name_col), case_sensitive).alias("alias_key"))
    j = keyed.join(p, "alias_key", "left").join(s, "alias_key", "left")
    return j.select(
        "name",
        F.coalesce("p_id", "s_id").alias("id"),
        F.when(F.col("p_id").isNotNull(), F.lit("primary"))
        .when(F.col("s_id").isNotNull(), F.lit("secondary")).alias("source"))


def pick_by_priority(requests: DataFrame, candidates: DataFrame, account: str,
                     request_col: str = "workspace_id", prefix: str = OWN_DATASOURCE_PREFIX,
                     kind: str = DATASOURCE_KIND) -> DataFrame:
    """Datasource choice per request: the request's own datasource, else the
    first root-level one of ``kind`` (no or an empty collection, or the account
    collection), else the first of ``kind`` anywhere, else create the own
    one.  Names, kinds and collections compare without letter case; "first" is
    by name (the listing order is not defined).

    The global fallbacks are single values (scalar subqueries), so requests
    are never paired with candidates beyond one equi join on the own name.
    (request, datasource, choice)."""
    own_name = F.concat(F.lit(prefix), F.col(request_col).cast("string"))
    req = requests.select(F.col(request_col).alias("request"), own_name.alias("own_name"))
    own = (candidates.groupBy(F.lower("name").alias("_key")).agg(F.min("name").alias("_own"))
           .where(F.col("_key").isNotNull()))
    of_kind = candidates.where(F.lower("kind") == F.lit(kind.lower()))
    root_level = F.coalesce(F.col("collection"), F.lit("")).isin("") | (F.lower("collection") == F.lit(account.lower()))
    root_first = of_kind.where(root_level).select(F.min("name")).scalar()
    any_first = of_kind.select(F.min("name")).scalar()
    j = req.join(own, F.lower("own_name") == F.col("_key"), "left")
    return j.select(
        "request",
        F.coalesce("_own", root_first, any_first, "own_name").alias("datasource"),
        F.when(F.col("_own").isNotNull(), F.lit("own"))
        .when(root_first.isNotNull(), F.lit("root"))
        .when(any_first.isNotNull(), F.lit("any"))
        .otherwise(F.lit("create")).alias("choice"))


def lookup_active(workspaces: DataFrame, capacities: DataFrame, cap_col: str = "capacityId",
                  active_state: str = "Active") -> DataFrame:
    """Left lookup against the active capacities only; label is the capacity
    name, ``Inactive Capacity (<id>)`` or ``None``."""
    active = capacities.where(F.lower("state") == F.lit(active_state.lower())) \
        .select(F.col("id").alias("_cap_id"), F.col("displayName").alias("_cap_name"))
    j = workspaces.join(active, F.col(cap_col) == F.col("_cap_id"), "left")
    label = (F.when(F.col(cap_col).isNull(), F.lit("None"))
             .when(F.col("_cap_id").isNotNull(), F.col("_cap_name"))
             .otherwise(F.concat(F.lit("Inactive Capacity ("), F.col(cap_col).cast("string"), F.lit(")"))))
    return j.withColumn("CapacityInfo", label) \
        .withColumn("hasActiveCapacity", F.col("_cap_id").isNotNull()) \
        .drop("_cap_id", "_cap_name")


def exclude_named(df: DataFrame, names: DataFrame, df_col: str = "displayName",
                  names_col: str = "name", case_sensitive: bool = False) -> DataFrame:
    """Drop rows whose name is listed (anti join; null-safe unlike NOT IN)."""
    ex = names.select(_fold(F.col(names_col), case_sensitive).alias("_ex")).distinct()
    return df.join(ex, _fold(F.col(df_col), case_sensitive) == F.col("_ex"), "left_anti")


def dependents_of(refs: DataFrame, targets: DataFrame, ref_col: str = "dataSourceName",
                  target_col: str = "name") -> DataFrame:
    """Rows of ``refs`` that reference one of the targets (semi join)."""
    t = targets.select(F.col(target_col).alias("_t")).distinct()
    return refs.join(t, F.col(ref_col) == F.col("_t"), "left_semi")


def dependent_closure(refs: DataFrame, targets: DataFrame, ref_col: str = "uses", name_col: str = "name",
                      target_col: str = "name", max_depth: int = 64) -> DataFrame:
    """Everything that depends on a target through any number of references: (target, name, depth, path),
    ``depth`` the fewest references and ``path`` the first of the shortest paths (element by element).

    ``refs`` has a row (name, uses) for each reference.  A breadth-first frontier: each round joins the
    names found last with the references to them, keeps one path per (target, name) combined map-side and
    drops what was found before, so cycles end and each name is expanded once a target.  Rounds are
    written, so no plan grows; a round's row count is all the driver sees.  A target is not its own
    dependant; null names and references are ignored."""
    spark = refs.sparkSession
    edges = (refs.select(F.col(ref_col).alias("_from"), F.col(name_col).alias("_to"))
             .where(F.col("_from").isNotNull() & F.col("_to").isNotNull()).distinct())
    root = scratch_path(spark, f"closure-{uuid.uuid4().hex[:12]}")
    edges.write.parquet(f"{root}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{root}/edges")
    start = targets.where(F.col(target_col).isNotNull()).select(
        F.col(target_col).alias("target"), F.col(target_col).alias("name"), F.array(F.col(target_col)).alias("path"),
        F.lit(0).alias("depth")).distinct()
    start.write.parquet(f"{root}/found/round=0")
    for depth in range(1, max_depth + 1):
        # each read lists only the rounds written so far
        found = spark.read.schema(start.schema).parquet(*[f"{root}/found/round={d}" for d in range(depth)])
        last = spark.read.schema(start.schema).parquet(f"{root}/found/round={depth - 1}")
        step = (last.join(edges, F.col("name") == F.col("_from"))
                .select("target", F.col("_to").alias("name"), F.array_append("path", F.col("_to")).alias("path"))
                .groupBy("target", "name").agg(F.min("path").alias("path"))
                .join(found.select("target", "name"), ["target", "name"], "left_anti")
                .select("target", "name", "path", F.lit(depth).alias("depth")))
        step.write.parquet(f"{root}/found/round={depth}")
        if spark.read.schema(start.schema).parquet(f"{root}/found/round={depth}").isEmpty():
            break
    else:
        raise RuntimeError(f"references are deeper than {max_depth}")
    done = spark.read.schema(start.schema).parquet(*[f"{root}/found/round={d}" for d in range(depth)])
    return done.where("depth > 0").select("target", "name", "depth", F.array_join("path", " > ").alias("path"))


def scope_filter(assets: DataFrame, scope: DataFrame, workspaces: DataFrame,
                 asset_ws_col: str = "workspace_id", personal_type: str = "Personal") -> DataFrame:
    """Assets of the scoped workspaces, personal workspaces excluded."""
    allowed = (workspaces.where(~F.coalesce(F.col("type") == F.lit(personal_type), F.lit(False)))
               .select(F.col("id").alias("_ws"))
               .join(scope.select(F.col("workspace_id").alias("_ws")), "_ws", "left_semi"))
    return assets.join(allowed, F.col(asset_ws_col) == F.col("_ws"), "left_semi")


def first_match(df: DataFrame, keys: list[str], order: list[str], value_cols: list[str]) -> DataFrame:
    """First row per key by ``order`` (ascending, total order expected) as an
    aggregate (``min_by`` of a struct): partial aggregation keeps a hot key
    from gathering its rows in one task."""
    payload = F.struct(*[F.col(c) for c in value_cols])
    ordering = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.min_by(payload, ordering).alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in value_cols]))
