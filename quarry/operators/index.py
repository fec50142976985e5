"""Index building: field mapping, chunking, tokenising, postings, statistics.

Index rows have the declared seven-field schema.  Postings carry the field
length ``dl`` of their document so scoring never joins back to a per-document
table, and statistics are computed with one global aggregate (one row per
field), so nothing in the build needs a broadcast or a skew-prone join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import document_key
from ..functions.text import CHUNK_OVERLAP, CHUNK_SIZE, chunk_at, chunk_offsets, term_frequencies, token_count, tokens

# The declared index schema and its per-field flags
# (key, searchable, filterable, sortable, facetable).
INDEX_FIELDS = [
    ("id", "string", True, False, True, True, True),
    ("content", "string", False, True, False, True, True),
    ("title", "string", False, True, True, True, True),
    ("file_name", "string", False, True, True, True, True),
    ("file_path", "string", False, False, True, True, True),
    ("last_modified", "timestamp_ntz", False, False, True, True, True),
    ("file_size", "bigint", False, False, True, True, True),
]
SEARCHABLE = [f[0] for f in INDEX_FIELDS if f[3]]
FILTERABLE = [f[0] for f in INDEX_FIELDS if f[4]]
FACETABLE = [f[0] for f in INDEX_FIELDS if f[6]]

# Source field → index field mapping of the indexer.
FIELD_MAPPING = [
    ("metadata_storage_path", "id"),
    ("content", "content"),
    ("metadata_title", "title"),
    ("metadata_storage_name", "file_name"),
    ("metadata_storage_path", "file_path"),
    ("metadata_storage_last_modified", "last_modified"),
    ("metadata_storage_size", "file_size"),
]


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "timestamp_ntz": T.TimestampNTZType()}


def index_schema() -> T.StructType:
    """The declared schema; per-field flags travel as column metadata."""
    fields = []
    for name, typ, key, searchable, filterable, sortable, facetable in INDEX_FIELDS:
        meta = {"key": key, "searchable": searchable, "filterable": filterable,
                "sortable": sortable, "facetable": facetable}
        fields.append(T.StructField(name, _TYPES[typ], not key, meta))
    return T.StructType(fields)


def map_fields(files: DataFrame, mapping=FIELD_MAPPING) -> DataFrame:
    """Source file rows → index rows.  One source field may feed two targets;
    the key target gets the URL-safe key of its source."""
    cols = []
    for src, dst in mapping:
        c = F.col(src)
        if dst == "id":
            c = document_key(c)
        cols.append(c.cast(_type_of(dst)).alias(dst))
    return files.select(*cols)


def _type_of(field: str) -> str:
    for f in INDEX_FIELDS:
        if f[0] == field:
            return f[1]
    raise KeyError(field)


def chunk_text(df: DataFrame, text_col: str = "content", key_col: str = "id",
               size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed windows of ``size`` characters, step ``size - overlap``; one chunk
    for short or empty text.  A narrow operator: no shuffle."""
    return (df.select(F.col(key_col), F.col(text_col),
                      F.posexplode(chunk_offsets(text_col, size, overlap)).alias("_p", "chunk_no"))
            .select(F.col(key_col), F.col("chunk_no"),
                    chunk_at(text_col, "chunk_no", size, overlap).alias("chunk")))


def field_values(docs: DataFrame, fields=SEARCHABLE) -> DataFrame:
    """Unpivot searchable fields into (id, field, value) with one scan."""
    args = ", ".join(f"'{f}', `{f}`" for f in fields)
    return docs.select("id", F.expr(f"stack({len(fields)}, {args}) AS (field, value)"))


def tokenize(docs: DataFrame, fields=SEARCHABLE) -> DataFrame:
    """(id, field, dl, term) — one row per token occurrence."""
    fv = field_values(docs, fields).select("id", "field", tokens("value").alias("toks"))
    # explode_outer + null filter: a plain explode makes the optimizer add a
    # non-empty filter that evaluates the tokenizer a second time
    return (fv.select("id", "field", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
            .where(F.col("term").isNotNull()))


def ids_repeat(docs: DataFrame) -> bool:
    """Whether any two rows have the same id (one pass over the ids alone)."""
    return not docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def row_postings(docs: DataFrame, fields=SEARCHABLE, keep=()) -> DataFrame:
    """(field, term, id, dl, tf) of every row by itself, with the columns ``keep``: the terms of a text are
    counted where it is read, so nothing is shuffled and no task holds more than a batch of texts."""
    args = ", ".join(f"'{f}', `{f}`" for f in fields)
    fv = docs.select("id", *keep, F.expr(f"stack({len(fields)}, {args}) AS (field, value)"))
    counted = (fv.select("id", *keep, "field", tokens("value").alias("toks"))
               .select("id", *keep, "field", F.size("toks").alias("dl"), term_frequencies("toks").alias("counts")))
    # inline_outer + null filter: a plain inline makes the optimizer add a filter that tokenizes a second time
    return (counted.select("id", *keep, "field", "dl", F.inline_outer("counts")).where(F.col("term").isNotNull())
            .select("field", "term", "id", "dl", "tf", *keep))


TERMS = "index_terms"


def with_terms(docs: DataFrame, fields=SEARCHABLE) -> DataFrame:
    """``docs`` with an array of (field, dl, counts of (term, tf)): a row's postings, kept in the row."""
    toks = docs.select("*", *[tokens(f).alias(f"_toks_{i}") for i, f in enumerate(fields)])
    held = [F.struct(F.lit(f).alias("field"), F.size(f"_toks_{i}").alias("dl"), term_frequencies(f"_toks_{i}").alias("counts"))
            for i, f in enumerate(fields)]
    return toks.select(*docs.columns, F.array(*held).alias(TERMS))


def postings_of_terms(rows: DataFrame) -> DataFrame:
    """:func:`row_postings` of rows that bear their terms."""
    per_field = rows.select("id", F.inline_outer(TERMS)).where(F.col("field").isNotNull())
    return (per_field.select("id", "field", "dl", F.inline_outer("counts")).where(F.col("term").isNotNull())
            .select("field", "term", "id", "dl", "tf"))


def build_postings(docs: DataFrame, fields=SEARCHABLE, unique: bool | None = None) -> DataFrame:
    """(field, term, id, dl, tf).  Ids are keys, so a row's postings are whole by themselves; only where ids
    do repeat (``unique`` None: looked up) are the postings of equal ids put together by a shuffle.  Rows that
    bear their terms (:func:`with_terms` of the same fields) are not tokenized again."""
    rows = postings_of_terms(docs) if TERMS in docs.columns else row_postings(docs, fields)
    if unique if unique is not None else not ids_repeat(docs):
        return rows
    return rows.groupBy("field", "term", "id", "dl").agg(F.sum("tf").alias("tf"))


def field_stats(docs: DataFrame, fields=SEARCHABLE) -> DataFrame:
    """Per field: number of documents and average field length (tokens)."""
    fv = field_values(docs, fields).select("field", token_count("value").alias("dl"))
    return fv.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.avg("dl").alias("avg_dl"))


def term_counts(postings: DataFrame) -> DataFrame:
    """(field, term, df, cf): documents and occurrences of each term.  The filter keeps every row; it
    keeps both counts in every plan that reads either, so that Spark reuses the one exchange and
    tokenizes once."""
    return (postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
            .where((F.col("df") > 0) & (F.col("cf") > 0)))


def field_stats_from_terms(terms: DataFrame, docs: DataFrame, fields=SEARCHABLE) -> DataFrame:
    """Field statistics without tokenizing again: a field's total length is
    the sum of its terms' cf; documents and non-null values are plain
    counts.  Equal to :func:`field_stats` (average over non-null values)."""
    fields = list(fields)
    counts = docs.agg(F.count(F.lit(1)).alias("n_docs"),
                      *[F.count(F.col(f)).alias(f) for f in fields])
    args = ", ".join(f"'{f}', `{f}`" for f in fields)
    per_field = counts.select("n_docs", F.expr(f"stack({len(fields)}, {args}) AS (field, present)"))
    lengths = terms.groupBy("field").agg(F.sum("cf").alias("_len"))
    return (per_field.join(lengths, "field", "left")          # ≤ one row per field on each side
            .select("field", "n_docs",
                    F.when(F.col("present") > 0, F.coalesce(F.col("_len"), F.lit(0)) / F.col("present"))
                    .alias("avg_dl")))


def corpus_stats(docs: DataFrame, postings: DataFrame | None = None, fields=SEARCHABLE) -> DataFrame:
    """(field, term, df, n_docs, avg_dl) — inputs of BM25 per term."""
    postings = postings if postings is not None else build_postings(docs, fields)
    terms = term_counts(postings)
    # one row per field (proven bound: number of fields)
    return terms.drop("cf").join(F.broadcast(field_stats_from_terms(terms, docs, fields)), "field")
