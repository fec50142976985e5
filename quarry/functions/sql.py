"""SQL-callable forms: ``safe_name`` as a scalar SQL function and
``chunk_text`` as a SQL table function (both SQL-bodied, so they inline into
Catalyst plans like built-ins)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .names import SLUG_INVALID, SLUG_MAX_LEN
from .text import CHUNK_OVERLAP, CHUNK_SIZE

_SLUG = f"btrim(regexp_replace(regexp_replace(lower(s), '{SLUG_INVALID}', '-'), '-+', '-'), '-')"


def register_sql_functions(spark: SparkSession) -> None:
    step = CHUNK_SIZE - CHUNK_OVERLAP
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION safe_name(s STRING) RETURNS STRING
        RETURN nullif(CASE WHEN length({_SLUG}) > {SLUG_MAX_LEN}
                           THEN btrim(left({_SLUG}, {SLUG_MAX_LEN}), '-') ELSE {_SLUG} END, '')""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION chunk_text(t STRING)
        RETURNS TABLE (chunk_no INT, chunk STRING)
        RETURN SELECT p AS chunk_no, substring(coalesce(t, ''), p * {step} + 1, {CHUNK_SIZE}) AS chunk
               FROM (SELECT explode(sequence(0, CASE WHEN length(coalesce(t, '')) <= {CHUNK_SIZE} THEN 0
                     ELSE CAST(ceil((length(t) - {CHUNK_SIZE}) / {step}.0) AS INT) END)) AS p)""")
