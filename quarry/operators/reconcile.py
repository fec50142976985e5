"""Desired-versus-actual reconciliation: missing grants, create/skip plans,
principal merges, outcome counts and joined name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import classify_outcome

GRANT_KEY = ["principal", "role", "scope"]


def missing_grants(desired: DataFrame, actual: DataFrame, key=GRANT_KEY) -> DataFrame:
    """Desired grants not present yet (anti join on the composite key)."""
    return desired.join(actual.select(*key).distinct(), list(key), "left_anti")


def granted(desired: DataFrame, actual: DataFrame, key=GRANT_KEY) -> DataFrame:
    """Desired grants already present (semi join) — the other half."""
    return desired.join(actual.select(*key).distinct(), list(key), "left_semi")


def reconcile(desired: DataFrame, existing: DataFrame, name_col: str = "name",
              case_sensitive: bool = False) -> DataFrame:
    """Each desired name → ``skip`` (an existing id is known) or ``create``.
    The existing side is reduced to one id per folded name by an aggregate."""
    fold = (lambda c: c) if case_sensitive else F.lower
    ex = existing.groupBy(fold(F.col(name_col)).alias("_k")).agg(F.min("id").alias("id"))
    d = desired.select(F.col(name_col).alias("name"), fold(F.col(name_col)).alias("_k"))
    return (d.join(ex, "_k", "left")
            .select("name", "id",
                    F.when(F.col("id").isNotNull(), F.lit("skip")).otherwise(F.lit("create")).alias("action")))


def merge_principals(current: DataFrame, added: DataFrame, key=("scope", "id")) -> DataFrame:
    """Keep existing principals, add new ones, no duplicate id per scope;
    on a collision the existing entry wins.  One aggregate (min_by on origin
    rank), so a crowded scope is combined map-side."""
    both = (current.withColumn("origin", F.lit("current")).withColumn("_o", F.lit(0))
            .unionByName(added.withColumn("origin", F.lit("added")).withColumn("_o", F.lit(1))))
    rest = [c for c in both.columns if c not in key and c != "_o"]
    payload = F.struct(*[F.col(c) for c in rest])
    return (both.groupBy(*key).agg(F.min_by(payload, F.col("_o")).alias("_p"))
            .select(*key, *[F.col(f"_p.{c}").alias(c) for c in rest]))


# Outcome classes counted as created / skipped / failed.
CREATED = ["created", "present"]
SKIPPED = ["skip", "skipped"]
FAILED = ["failed", "unsupported", "exhausted"]


def outcome_summary(df: DataFrame, group_cols: list[str], outcome_col: str = "outcome") -> DataFrame:
    """created / skipped / failed / pending per group ("name in use" counts as
    created, unsupported SKU as failed)."""
    o = F.col(outcome_col)
    return df.groupBy(*group_cols).agg(
        F.count_if(o.isin(CREATED)).alias("created"),
        F.count_if(o.isin(SKIPPED)).alias("skipped"),
        F.count_if(o.isin(FAILED)).alias("failed"),
        F.count_if(~o.isin(CREATED + SKIPPED + FAILED)).alias("pending"))


def joined_names(df: DataFrame, group_cols: list[str], name_col: str, sep: str = ", ") -> DataFrame:
    """Sorted, ``sep``-joined names per group.  Meant for listings (bounded
    groups): the joined string itself holds the whole group."""
    sep_sql = sep.replace("'", "''")
    return df.groupBy(*group_cols).agg(
        F.expr(f"listagg(`{name_col}`, '{sep_sql}') WITHIN GROUP (ORDER BY `{name_col}`)").alias("names"))


def attempt_log(attempts: DataFrame, cap: int = 6, item_col: str = "item",
                order=("ts", "event_id")) -> DataFrame:
    """Replay a retry loop per item: number the attempts, keep the first
    ``cap`` (partial group limit before the shuffle), classify each, and stop
    at the first terminal outcome.  ``attempts_seen`` counts all attempts, also those
    past the cap.  (item, outcome, attempts_used, attempts_seen)."""
    from pyspark.sql import Window
    w = Window.partitionBy(item_col).orderBy(*[F.col(c).asc() for c in order])
    numbered = attempts.withColumn("attempt", F.row_number().over(w)).where(F.col("attempt") <= cap)
    cls = numbered.withColumn("class", classify_outcome("code", "body"))
    terminal = F.col("class") != F.lit("retry")
    g = cls.groupBy(item_col).agg(
        F.min_by(F.col("class"), F.when(terminal, F.col("attempt"))).alias("_first_terminal"),
        F.min(F.when(terminal, F.col("attempt"))).alias("_first_attempt"),
        F.count(F.lit(1)).alias("_tried"))
    seen = attempts.groupBy(item_col).agg(F.count(F.lit(1)).alias("attempts_seen"))
    g = g.join(seen, item_col)
    outcome = (F.when(F.col("_first_terminal").isNotNull(), F.col("_first_terminal"))
               .when(F.col("_tried") >= cap, F.lit("exhausted"))
               .otherwise(F.lit("pending")))
    used = F.coalesce(F.col("_first_attempt"), F.col("_tried"))
    return g.select(item_col, outcome.alias("outcome"), used.cast("int").alias("attempts_used"),
                    F.col("attempts_seen").cast("int").alias("attempts_seen"))


def plan_outcomes(plan: DataFrame, outcomes: Column | None = None) -> DataFrame:
    """Plan rows labelled for ``outcome_summary``: skip → skipped."""
    return plan.withColumn("outcome", F.when(F.col("action") == "skip", F.lit("skipped"))
                           .otherwise(outcomes if outcomes is not None else F.lit("pending")))
