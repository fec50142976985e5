"""Regular-expression matches with code-point offsets, in built-in functions only.

``regexp_extract_all`` gives the matches of a pattern and ``split`` the text between them, both
by the same leftmost non-overlapping search, so offsets are running sums of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
MARK = "\ue000"  # a private code point


def _running(values: Column, start: Column) -> Column:
    """start, start + v1, start + v1 + v2, ... without the last sum."""
    sums = F.aggregate(values, F.array(start),
                       lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    return F.slice(sums, F.lit(1), F.size(values))


def starts(lengths: Column) -> Column:
    """Running sums before each element of an array of longs, in blocks so that many matches
    cost little more than linear time."""
    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    many = F.flatten(F.zip_with(blocks, _running(totals, zero), _running))
    return (F.when(F.size(lengths) == 0, F.array().cast("array<long>"))
            .when(F.size(lengths) <= BLOCK, _running(lengths, zero)).otherwise(many))


SPAN = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def with_matches(df: DataFrame, name: str, text: Column, pattern: str, only_if: Column | None = None,
                 before: int = 40, after: int = 20, searched_once: bool = False) -> DataFrame:
    """Add ``name``: array<struct<start, end, value, left, right>> of the matches, with the text
    right before and after each, up to the neighbouring matches.  ``only_if`` is a cheap test
    that every text with a match passes.  Each step is a column of its own, so that none is
    evaluated again for every element.  ``searched_once``: one search marks the matches in the text, which is
    cut at the marks (texts that hold the mark itself are searched twice)."""
    g, m, n, at = (f"__{name}_{x}" for x in ("gaps", "found", "len", "at"))
    empty = F.array().cast(SPAN)
    held = F.lit(True) if only_if is None else only_if
    if searched_once:
        marked, plain = f"__{name}_marked", ~F.contains(text, F.lit(MARK))
        df = df.withColumn(marked, F.when(held & plain, F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)))

        def every_second(first):
            return F.filter(marked, lambda v, i: i % 2 == first)
        df = df.withColumn(m, F.when(held & plain, every_second(1)).when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.when(plain, every_second(0)).otherwise(F.split(text, pattern, -1)))).drop(marked)
    else:
        df = df.withColumn(m, F.when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    df = df.withColumn(n, F.zip_with(m, F.slice(g, F.lit(1), F.size(m)),
                                     lambda v, gap: (F.length(v) + F.length(gap)).cast("long")))
    df = df.withColumn(at, F.when(F.size(m) > 0, starts(F.col(n))))
    out = F.transform(F.arrays_zip(F.col(m).alias("v"), F.col(at).alias("at")), lambda x, i: F.struct(
        (x["at"] + F.length(F.get(F.col(g), i))).alias("start"),
        (x["at"] + F.length(F.get(F.col(g), i)) + F.length(x["v"])).alias("end"),
        x["v"].alias("value"),
        F.right(F.get(F.col(g), i), F.lit(before)).alias("left"),
        F.left(F.get(F.col(g), i + 1), F.lit(after)).alias("right")))
    return df.withColumn(name, F.when(F.size(m) > 0, out).otherwise(empty)).drop(g, m, n, at)
