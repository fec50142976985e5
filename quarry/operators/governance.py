"""Governance jobs: orphan report, scoped catalog profile, layered config."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import old_enough, usable
from .lookups import lookup_active, scope_filter


def orphan_candidates(workspaces: DataFrame, capacities: DataFrame, excluded: DataFrame,
                      now: Column, max_age_days: int = 7) -> DataFrame:
    """Every workspace with its exclusion flag, age check and capacity label —
    one plan (two lookups, no per-row calls)."""
    ex = excluded.select(F.lower("name").alias("_ex")).distinct()
    flagged = (workspaces.join(ex, F.lower("displayName") == F.col("_ex"), "left")
               .withColumn("excluded", F.col("_ex").isNotNull()).drop("_ex"))
    labelled = lookup_active(flagged, capacities)
    return labelled.withColumn("old_enough", old_enough(F.col("createdDate"), now, max_age_days)) \
        .withColumn("orphan", ~F.col("excluded") & F.col("old_enough") & F.col("capacityId").isNull())


def orphan_report(workspaces: DataFrame, capacities: DataFrame, excluded: DataFrame,
                  now: Column, max_age_days: int = 7) -> DataFrame:
    """Not excluded, old enough, no capacity id at all (inactive capacity is
    kept).  (Id, Name, Type, CapacityInfo, Description)."""
    c = orphan_candidates(workspaces, capacities, excluded, now, max_age_days)
    return c.where("orphan").select(F.col("id").alias("Id"), F.col("displayName").alias("Name"),
                                    F.col("type").alias("Type"), "CapacityInfo",
                                    F.col("description").alias("Description"))


def orphan_totals(workspaces: DataFrame, capacities: DataFrame, excluded: DataFrame,
                  now: Column, max_age_days: int = 7) -> DataFrame:
    """Totals: all workspaces, length of the exclusion list, orphans, and the
    kept workspaces on an inactive capacity."""
    c = orphan_candidates(workspaces, capacities, excluded, now, max_age_days)
    listed = excluded.select(F.count(F.lit(1))).scalar()
    return c.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if("excluded").alias("excluded"),
                 F.count_if("orphan").alias("orphans"),
                 F.count_if(F.col("capacityId").isNotNull() & ~F.col("hasActiveCapacity"))
                 .alias("inactive_capacity")) \
        .select("total", listed.alias("exclusion_list"), "excluded", "orphans", "inactive_capacity")


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def profile_table(df: DataFrame, table_name: str, approx: bool = True) -> DataFrame:
    """One aggregate pass over a table → one row per column: type, rows,
    nulls, (approximate) distinct values, min and max.  Nested and binary
    columns have no min and max; maps no distinct count either."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    cols = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        if approx:
            known = F.lit(None).cast("bigint") if isinstance(f.dataType, T.MapType) else F.approx_count_distinct(c)
            aggs.append(known.alias(f"d{i}"))
        if isinstance(f.dataType, _NUMERIC):
            aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"),
                     F.lit(None).cast("string").alias(f"ls{i}"), F.lit(None).cast("string").alias(f"hs{i}")]
        elif isinstance(f.dataType, nested):
            aggs += [F.lit(None).cast("double").alias(f"lo{i}"), F.lit(None).cast("double").alias(f"hi{i}"),
                     F.lit(None).cast("string").alias(f"ls{i}"), F.lit(None).cast("string").alias(f"hs{i}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"lo{i}"), F.lit(None).cast("double").alias(f"hi{i}"),
                     F.min(c).cast("string").alias(f"ls{i}"), F.max(c).cast("string").alias(f"hs{i}")]
    one = df.agg(*aggs)
    parts = []
    for i, f in enumerate(cols):
        d = f"d{i}" if approx else "CAST(NULL AS BIGINT)"
        parts.append(f"'{f.name}', '{f.dataType.simpleString()}', n{i}, {d}, lo{i}, hi{i}, ls{i}, hs{i}")
    stack = F.expr(f"stack({len(cols)}, {', '.join(parts)}) AS "
                   "(column, type, nulls, distinct_approx, min_num, max_num, min_str, max_str)")
    out = one.select(F.col("_rows").alias("rows"), stack).withColumn("table", F.lit(table_name))
    cols_out = ["table", "column", "type", "rows", "nulls"] + (["distinct_approx"] if approx else []) + \
        ["min_num", "max_num", "min_str", "max_str"]
    return out.select(*cols_out)


def catalog_scan(tables: dict[str, DataFrame], scope: DataFrame | None = None,
                 workspaces: DataFrame | None = None, workspace_cols: dict[str, str] | None = None,
                 approx: bool = True) -> DataFrame:
    """Scoped asset discovery: tables with a workspace column
    (``workspace_cols``) keep only rows of in-scope, non-personal
    workspaces; every table is profiled in one pass and the per-column rows
    are unioned."""
    if scope is not None and workspaces is not None:
        tables = {name: (scope_filter(df, scope, workspaces, asset_ws_col=(workspace_cols or {})[name])
                         if name in (workspace_cols or {}) else df)
                  for name, df in tables.items()}
    return reduce(DataFrame.unionByName, [profile_table(df, name, approx) for name, df in tables.items()])


def resolve_config(layers: DataFrame, keys=("env", "key")) -> DataFrame:
    """Per (env, key): the highest-priority (lowest number) present,
    non-placeholder value and the layer it came from; null when none."""
    ok = usable(F.col("value"))
    pick = F.min_by(F.struct(ok.alias("value"), F.col("layer")), F.when(ok.isNotNull(), F.col("priority")))
    return (layers.groupBy(*keys).agg(pick.alias("_p"))
            .select(*keys, F.col("_p.value").alias("value"), F.col("_p.layer").alias("layer")))
