"""Catalog profiles from mergeable states, stored per partition and merged for any scope.

``profile_states`` makes one pass over a table: per partition and column the rows, nulls, extremes, a
HyperLogLog sketch of the values and, for numbers, a KLL quantile sketch.  ``write_states`` replaces the
partitions it is given and leaves the others, so a changed partition is profiled alone.
``merge_states`` unions the sketches of a scope's partitions; the table is not read again.

Error bounds (Datasketches, default sizes): distinct counts within 3 x 1.04 / sqrt(2 ** 12) of the exact
number in 99.7 % of cases, quantiles within ``KLL_RANK`` of the rows around their rank in 99 %.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .governance import _NUMERIC

LG_K = 12
DISTINCT_ERROR = 3 * 1.04 / sqrt(1 << LG_K)
KLL_RANK = 0.0165
QUANTILES = (0.25, 0.5, 0.75)


def profile_states(df: DataFrame, table: str, part: Column) -> DataFrame:
    """(table, part, column, type, rows, nulls, min_num, max_num, min_str, max_str, distinct, quantiles):
    the last two are sketches.  Columns of nested types have rows and nulls only; a null partition value
    is a partition."""
    cols = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    none = {"d": "cast(null as double)", "s": "cast(null as string)", "b": "cast(null as binary)"}
    parts = []
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        have = {}
        if isinstance(f.dataType, _NUMERIC):
            number = c.cast("double")
            aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"),
                     F.hll_sketch_agg(c.cast("string"), LG_K).alias(f"h{i}"),
                     F.kll_sketch_agg_double(F.when(~F.isnan(number), number)).alias(f"q{i}")]
            have = {"lo", "hi", "h", "q"}
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            aggs += [F.min(c).cast("string").alias(f"ls{i}"), F.max(c).cast("string").alias(f"hs{i}"),
                     F.hll_sketch_agg(c.cast("string"), LG_K).alias(f"h{i}")]
            have = {"ls", "hs", "h"}
        cell = [f"{k}{i}" if k in have else none[t] for k, t in (("lo", "d"), ("hi", "d"), ("ls", "s"), ("hs", "s"), ("h", "b"), ("q", "b"))]
        parts.append(f"'{f.name}', '{f.dataType.simpleString()}', n{i}, {', '.join(cell)}")
    one = df.groupBy(part.cast("string").alias("part")).agg(*aggs)
    stack = F.expr(f"stack({len(cols)}, {', '.join(parts)}) AS "
                   "(column, type, nulls, min_num, max_num, min_str, max_str, distinct, quantiles)")
    return (one.select("part", F.col("_rows").alias("rows"), stack).withColumn("table", F.lit(table))
            .select("table", "part", "column", "type", "rows", "nulls", "min_num", "max_num", "min_str", "max_str",
                    "distinct", "quantiles"))


def write_states(states: DataFrame, root: str) -> None:
    """Store states, replacing those of the same tables and partitions only."""
    (states.repartition("table", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("table", "part").parquet(root))


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """Stored states; tables and partitions as text whatever they look like."""
    kinds = ("column string, type string, rows long, nulls long, min_num double, max_num double, min_str string, max_str string, "
             "distinct binary, quantiles binary, table string, part string")
    return spark.read.schema(kinds).parquet(root)


def merge_states(states: DataFrame) -> DataFrame:
    """One row per (table, column) over the partitions in ``states``: rows, nulls, extremes, the estimated
    distinct values and quartiles."""
    merged = states.groupBy("table", "column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"),
        F.min("min_str").alias("min_str"), F.max("max_str").alias("max_str"), F.hll_union_agg("distinct").alias("_d"),
        F.count("distinct").alias("_sketched"), F.kll_merge_agg_double("quantiles").alias("_q"))
    known = F.when(F.col("_sketched") > 0, F.hll_sketch_estimate("_d"))
    held = F.kll_sketch_get_n_double("_q") > 0
    quartiles = [F.when(held, F.kll_sketch_get_quantile_double("_q", F.lit(q))).alias(f"q{round(100 * q)}") for q in QUANTILES]
    return merged.select("table", "column", "type", "rows", "nulls", "min_num", "max_num", "min_str", "max_str",
                         known.alias("distinct_approx"), *quartiles)


def with_accuracy(merged: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``merged`` with ``distinct_ok`` and ``quartiles_ok``: whether the estimates lie within their error
    bounds of the exact figures, which are counted from the tables (null where there is no sketch)."""
    exact = []
    for name, df in tables.items():
        mine = merged.where(F.col("table") == name)
        aggs, parts = [], []
        cells = {r["column"]: r for r in mine.collect()}  # one row a column
        for i, f in enumerate(df.schema.fields):
            row, c = cells.get(f.name), F.col(f"`{f.name}`")
            if row is None or row["distinct_approx"] is None:
                parts.append(f"'{f.name}', cast(null as long), cast(null as boolean)")
                continue
            aggs.append(F.count_distinct(c).alias(f"d{i}"))
            ok = F.lit(None).cast("boolean")
            if row["q50"] is not None:
                number = c.cast("double")
                n = F.count(F.when(~F.isnan(number), 1))
                ranks = [(F.count_if(number < row[f"q{round(100 * q)}"]) <= (q + KLL_RANK) * n)
                         & (F.count_if(number <= row[f"q{round(100 * q)}"]) >= (q - KLL_RANK) * n) for q in QUANTILES]
                ok = reduce(Column.__and__, ranks)
            aggs.append(ok.alias(f"k{i}"))
            parts.append(f"'{f.name}', d{i}, k{i}")
        if not parts:
            continue
        one = df.agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
        exact.append(one.select(F.lit(name).alias("table"), F.expr(f"stack({len(parts)}, {', '.join(parts)}) AS (column, exact, quartiles_ok)")))
    figures = reduce(DataFrame.unionByName, exact)
    off = F.abs(F.col("distinct_approx") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * F.lit(DISTINCT_ERROR))
    return merged.join(figures, ["table", "column"]).withColumn("distinct_ok", off).drop("exact")
