"""BM25 search, filters, facets, coverage and batch retrieval.

Single query (``bm25_search``, ``filtered_search``, ``match_count``):

  documents ─stack fields─ tokenize ─ filter each token array by the set of
  query terms ─ explode ─ partial agg (field, term, id, dl) → tf ─ shuffle
  (matching tokens only) ─ ⋈ df per query term (≤ terms × fields rows, reused
  exchange) ⋈ field stats (one row per field) ─ Σ per doc ─ TakeOrderedAndProject.

Many queries (``retrieve_batch``):

  documents ─ tokenize ─ drop tokens of no query in the map task ─ shuffle the
  matching ones by id ─ tf of all fields ─ written once ─ df per term ─ weights,
  written once ─ top k per query by block bounds (``pruned_hits``):
  floor    the documents of each query's rarest terms, the best of them scored
           whole: the k-th best score is a floor
  bounds   Σ over the query's terms of the largest weight in a range of documents of
           like length; ranges whose sum is below the floor are dropped
  scores   only the documents of the ranges that are left, then top k.

Persisted index (``write_search_index``, ``search_index``, ``retrieve_index``):
postings partitioned by field and clustered by term; searches read only their
terms' postings.  An index for impacts keeps the postings of some documents
together instead (runs of documents, each sorted by term), so that neither
building nor scoring moves postings.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BM25_B, BM25_K1, tokens
from ..session import scratch_path
from ..sources.sinks import write_postings
from .index import (FACETABLE, INDEX_FIELDS, SEARCHABLE, build_postings, field_stats, field_stats_from_terms,
                    ids_repeat, row_postings, term_counts)

SCORE_DIGITS = 6


def query_term_list(spark: SparkSession, query: str) -> list[str]:
    """Distinct analysed terms of one query string (a parameter, bounded by
    its length) — computed by the same JVM tokenizer as the index."""
    rows = spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("t")).collect()
    return sorted(r.t for r in rows)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, term): distinct analysed terms of each query."""
    return queries.select(F.col(id_col).alias("query_id"),
                          F.explode(F.array_distinct(tokens(text_col))).alias("term"))


def _field_tokens(docs: DataFrame, fields, keep: Column | None, block: Column | None = None) -> DataFrame:
    """(id, _keep, field, dl, toks): one row per document field; ``block`` is kept if given."""
    extra = [] if block is None else ["block"]
    base = docs.select("id", (keep if keep is not None else F.lit(True)).alias("_keep"),
                       *([] if block is None else [block.alias("block")]), *[F.col(f) for f in fields])
    args = ", ".join(f"'{f}', `{f}`" for f in fields)
    fv = base.select("id", "_keep", *extra, F.expr(f"stack({len(fields)}, {args}) AS (field, value)"))
    tok = fv.select("id", "_keep", *extra, "field", tokens("value").alias("toks"))
    return tok.select("id", "_keep", *extra, "field",
                      F.when(F.col("toks").isNotNull(), F.size("toks")).alias("dl"), "toks")


def _postings_of(tok: DataFrame, terms: DataFrame | list[str]) -> DataFrame:
    """(field, term, id, dl, _keep, tf) for the query terms only.

    The terms of a literal query (a list) filter each token array by a hash
    set before it is exploded, so only matching tokens become rows; a table of
    terms is semi-joined with the tokens in the map tasks.  ``explode_outer``
    plus a null filter keeps the optimizer from re-running the tokenizer in an
    inferred non-empty-array filter."""
    toks = F.col("toks")
    if isinstance(terms, list):
        toks = F.filter("toks", lambda t: t.isin(terms) if terms else F.lit(False))
    keys = ["id", "_keep", "field", "dl", *[c for c in ("block",) if c in tok.columns]]
    occ = tok.select(*keys, F.explode_outer(toks).alias("term")).where(F.col("term").isNotNull())
    if isinstance(terms, list):
        return occ.groupBy("term", *keys).agg(F.count(F.lit(1)).alias("tf"))
    # many queries: what matches moves once, by document, and every later aggregate is keyed by a
    # superset of it
    occ = occ.join(terms, "term", "left_semi").repartition("id")
    return occ.groupBy("term", *keys).agg(F.count(F.lit(1)).alias("tf"))


def _bm25(tf: Column, dl: Column, df_: Column, n: Column, avg_dl: Column,
          k1: float = BM25_K1, b: float = BM25_B) -> Column:
    return _saturated(_idf(df_, n), tf, dl, avg_dl, k1, b)


def _idf(df_: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df_ + F.lit(0.5)) / (df_ + F.lit(0.5)))


def _saturated(idf: Column, tf: Column, dl: Column, avg_dl: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avg_dl)
    return idf * tf * F.lit(k1 + 1.0) / norm


def score_hits(docs: DataFrame, terms: list[str], fields=SEARCHABLE, keep: Column | None = None) -> DataFrame:
    """(id, score) for every document sharing a term with one query.

    Statistics (N, avg length, df) are global over ``docs``; ``keep`` only
    restricts which documents are scored.  Only matching tokens move; lengths
    are counted with ``regexp_count`` in a second scan."""
    fields = list(fields)
    stats = F.broadcast(field_stats(docs, fields))               # one row per field
    mp = _postings_of(_field_tokens(docs, fields, keep), terms)
    # df and the collection frequency cf; using cf (every posting has tf >= 1,
    # so the filter keeps all rows) keeps tf from being pruned in this branch,
    # which makes its postings exchange identical to the scoring branch's and
    # lets Spark reuse it instead of tokenizing the documents again
    dfreq = (mp.groupBy("field", "term")
             .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
             .where(F.col("cf") > 0).drop("cf"))
    # one row per (field, term) of the query: bounded by its length
    return (_weighted(mp.where(F.col("_keep")), F.broadcast(dfreq), stats)
            .groupBy("id").agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))


def _weighted(postings: DataFrame, dfreq: DataFrame, stats: DataFrame, keep=()) -> DataFrame:
    """(term, id, w): the BM25 weight of every posting."""
    return (postings.join(dfreq, ["field", "term"]).join(stats, "field")
            .select("term", "id", *keep, _bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"),
                                        F.col("avg_dl")).alias("w")))


def _fan_out(weights: DataFrame, qterms: DataFrame) -> DataFrame:
    """(query_id, id, score).  ``weights`` are partitioned by document here, so summing the fields per
    (term, document) and the terms per (query, document) happens inside tasks: the fan-out to the
    queries never crosses the network."""
    per_term = weights.repartition("id").groupBy("term", "id").agg(F.sum("w").alias("w"))
    return (per_term.join(qterms, "term").groupBy("query_id", "id")
            .agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))


# Chosen here: documents of a range, steps of a document's length in which ranges are alike and how many of them
# most documents fall into, documents of a query's rarest terms that give a floor and how many of the best are
# scored whole for it, and how far a sum of weights may lie from the same sum rounded.
BLOCK_DOCS = 4
LENGTH_STEPS = 8
USUAL_STEPS = 32
SEED_DOCS = 256
SEED_BEST = 20
ROUNDING = 2e-6
# Chosen here: rows of a batch (of queries' terms, or of open ranges) that are sent to all tasks, terms whose document
# frequencies are, steps of a stored bound within a factor of two, bytes of tokens that a task turns into one run of
# postings, rows it gives back at once.
SENT_ROWS = 1 << 20
SENT_TERMS = 1 << 19
BOUND_STEPS = 256
RUN_BYTES = 16 << 20
OUT_ROWS = 1 << 15


def block_of(id_col: Column, length: Column, n_docs: int) -> Column:
    """The range of a document: some ``BLOCK_DOCS`` documents of nearly the same length, whose largest
    weights are close to their own."""
    blocks = max(1, n_docs // (BLOCK_DOCS * USUAL_STEPS))
    alike = F.floor(F.log2(F.greatest(length, F.lit(0)) + 1) * LENGTH_STEPS)
    return alike.cast("long") * F.lit(blocks) + F.pmod(F.xxhash64(id_col), F.lit(blocks))


def document_weights(postings: DataFrame, dfreq: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, id, block, w): the weight of a term in a document over all fields; ``postings`` bring the
    documents' ranges."""
    return _weighted(postings, dfreq, stats, keep=["block"]).groupBy("id", "term", "block").agg(F.sum("w").alias("w"))


def block_bounds(weights: DataFrame) -> DataFrame:
    """(term, block, bound): the largest weight of a term in any document of a range."""
    return weights.groupBy("term", "block").agg(F.max("w").alias("bound"))


def batch_weights(docs: DataFrame, qterms: DataFrame, fields=SEARCHABLE, keep: Column | None = None) -> DataFrame:
    """:func:`document_weights` of a batch's terms, written once.

    Documents are tokenized once; tokens of no query are dropped in the map task, and the others move once, by
    document.  Ids are keys, so a term's row of a document holds all its fields and is its weight by itself, once
    the documents of the terms are counted; only where ids do repeat are fields kept apart as postings.  The
    batch's terms carry no hint, so a batch within the session's broadcast threshold is broadcast and a larger
    one shuffled."""
    fields = list(fields)
    repeat = ids_repeat(docs)
    length = F.lit(0) if repeat else F.length(F.concat_ws(" ", *fields))  # all rows of an id lie in one range
    tok = _field_tokens(docs, fields, keep, block_of(F.col("id"), length, docs.count()))
    terms = qterms.select("term").distinct()
    if repeat:
        mp = _postings_of(tok, terms)
        dfreq = mp.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        stats = F.broadcast(field_stats(docs, fields))               # one row per field
        return _materialised(document_weights(mp.where(F.col("_keep")), dfreq, stats), "batch-weights")
    rows = _materialised(_term_rows(tok, terms, fields), "batch-terms")
    there = rows.where(F.col("term") != NO_TERM)
    dfs = _materialised(there.groupBy("term").agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(fields))]),
                        "batch-frequencies")
    stats = rows.where(F.col("term") == NO_TERM).agg(F.count(F.lit(1)).alias("n_docs"),
                                                     *[F.avg(f"dl_{i}").alias(f"avg_{i}") for i in range(len(fields))])
    w = sum((F.when(F.col(f"tf_{i}") > 0, _bm25(*[F.col(c) for c in (f"tf_{i}", f"dl_{i}", f"df_{i}", "n_docs", f"avg_{i}")]))
             .otherwise(F.lit(0.0)) for i in range(len(fields))), F.lit(0.0))
    met = there.where(F.col("_keep")).join(dfs, "term").crossJoin(F.broadcast(stats))  # one row
    return _materialised(met.select("term", "id", "block", w.alias("w")), "batch-weights")


NO_TERM = ""  # the term of the row that every document has, whatever its texts


def _term_rows(tok: DataFrame, terms: DataFrame, fields: list[str]) -> DataFrame:
    """(term, id, _keep, block, tf_0 ..., dl_0 ...): a row for every term of the batch in a document, with its
    occurrences in every field and the fields' lengths (null: the term is not there), and one of ``NO_TERM``
    with all lengths, so that the fields' averages need no second pass over the texts."""
    spark = tok.sparkSession
    toks = F.concat(F.coalesce("toks", F.array().cast("array<string>")), F.array(F.lit(NO_TERM)))
    occ = tok.select("id", "_keep", "block", "field", "dl", F.explode_outer(toks).alias("term")).where(F.col("term").isNotNull())
    wanted = terms.unionByName(spark.range(1).select(F.lit(NO_TERM).alias("term")))
    here = [F.col("field") == f for f in fields]
    return (occ.join(wanted, "term", "left_semi").repartition("id").groupBy("term", "id", "_keep", "block")
            .agg(*[F.count_if(x).alias(f"tf_{i}") for i, x in enumerate(here)],
                 *[F.max(F.when(x, F.col("dl"))).alias(f"dl_{i}") for i, x in enumerate(here)]))


def _materialised(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batch_hits(docs: DataFrame, queries: DataFrame, fields=SEARCHABLE, keep: Column | None = None) -> DataFrame:
    """(query_id, id, score) for every document sharing a term with a query of a batch: queries times
    documents, for those who want all of them."""
    qterms = query_terms(queries)
    return _fan_out(batch_weights(docs, qterms, fields, keep), qterms)


def top_k_per_query(hits: DataFrame, k: int = 5, group: str = "query_id",
                    score: str = "score", tie: str = "id") -> DataFrame:
    """Best k rows per group; Spark plans a partial WindowGroupLimit before the
    shuffle, so a group never gathers more than k rows per input partition."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return (hits.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Global top-k (TakeOrderedAndProject) with a 1-based rank; the rank
    window sees only the k surviving rows."""
    limited = df.orderBy(*order).limit(k)
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25_search(docs: DataFrame, query: str, k: int = 5, fields=SEARCHABLE,
                where: Column | None = None) -> DataFrame:
    """Ranked search for one query: any term matches, per-field BM25 summed
    over fields, ties on id.  (rank, id, score)."""
    hits = score_hits(docs, query_term_list(docs.sparkSession, query), fields, keep=where)
    return top_k(hits, k, [F.col("score").desc(), F.col("id").asc()]).select("rank", "id", "score")


def filtered_search(docs: DataFrame, query: str, where: Column, k: int = 5) -> DataFrame:
    """Search restricted by a predicate on filterable fields; statistics stay
    global over the whole index."""
    return bm25_search(docs, query, k, where=where)


def match_count(docs: DataFrame, query: str, fields=SEARCHABLE) -> DataFrame:
    """Number of documents matching any term of the query."""
    mp = _postings_of(_field_tokens(docs, list(fields), None), query_term_list(docs.sparkSession, query))
    return mp.agg(F.count_distinct("id").alias("matches"))


def match_all(docs: DataFrame, k: int = 3) -> DataFrame:
    """Query ``*``: every document matches; total count plus the first k by id."""
    total = docs.select(F.count(F.lit(1))).scalar()
    first = top_k(docs.select("id", "file_name"), k, [F.col("id").asc()])
    return first.select("rank", "id", "file_name", total.alias("total"))


def score_floors(weights: DataFrame, qterms: DataFrame, k: int, whole_scores=None) -> DataFrame:
    """(query_id, floor): the k-th best score among the documents of each query's rarest terms, in whole
    scores; no row for a query whose rarest terms have fewer than k documents."""
    df = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    before = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term")
                              .rowsBetween(Window.unboundedPreceding, -1))  # a query's own terms
    # written, like the best below: their sizes are known, and if they are small the weights need not move
    rare = _materialised(qterms.join(df, "term").withColumn("before", F.coalesce(before, F.lit(0)))
                         .where(F.col("before") < SEED_DOCS).select("query_id", "term"), "rare-terms")
    partial = weights.join(rare, "term").groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    best = _materialised(top_k_per_query(partial, max(SEED_BEST, 2 * k)).select("query_id", "id"), "best-documents")
    whole = (whole_scores or _whole_scores)(best, weights, qterms)
    return (top_k_per_query(whole, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
            .where(F.col("n") >= k).select("query_id", "floor"))


def _whole_scores(pairs: DataFrame, weights: DataFrame, qterms: DataFrame) -> DataFrame:
    """(query_id, id, score) of some pairs of query and document."""
    wanted = weights.select("id", "term", "w").join(pairs.select("id").distinct(), "id", "left_semi")
    return (pairs.join(qterms, "query_id").join(wanted, ["id", "term"]).groupBy("query_id", "id")
            .agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))


def open_blocks(weights: DataFrame, bounds: DataFrame, qterms: DataFrame, k: int, min_score: float | None = None,
                whole_scores=None) -> DataFrame:
    """(query_id, block): the ranges that may hold one of a query's k best documents, those whose bounds over
    the query's terms add up to its floor at least.  Bounds come dealt out by range, so that the sums stay
    inside tasks."""
    least = F.coalesce(F.col("floor"), F.lit(float("-inf")))
    if min_score is not None:
        least = F.greatest(least, F.lit(float(min_score)))
    sums = bounds.join(qterms, "term").groupBy("block", "query_id").agg(F.sum("bound").alias("sum"))
    floors = _sent(_materialised(score_floors(weights, qterms, k, whole_scores), "score-floors"))  # a row a query
    return (sums.join(floors, "query_id", "left").where(F.col("sum") >= least - F.lit(ROUNDING))
            .select("query_id", "block"))


def pruned_hits(weights: DataFrame, bounds: DataFrame, qterms: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, id, score) of the documents of a query's open ranges, in whole scores: every one of its k best
    is a row."""
    blocks = _materialised(open_blocks(weights, bounds, qterms, k, min_score), "open-blocks")
    hits = (weights.join(blocks.join(qterms, "query_id"), ["block", "term"]).groupBy("query_id", "id")
            .agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))
    return hits if min_score is None else hits.where(F.col("score") >= F.lit(min_score))


def retrieve_hits(queries: DataFrame, docs: DataFrame, k: int = 5, min_score: float | None = None, fields=SEARCHABLE,
                  where: Column | None = None) -> DataFrame:
    """(query_id, id, score): the documents that :func:`retrieve_batch` scores whole."""
    qterms = query_terms(queries)
    weights = batch_weights(docs, qterms, fields, where)
    return pruned_hits(weights, block_bounds(weights.repartition("block")), qterms, k, min_score)


def retrieve_batch(queries: DataFrame, docs: DataFrame, k: int = 5, min_score: float | None = None,
                   fields=SEARCHABLE, where: Column | None = None) -> DataFrame:
    """Many questions at once: top-k passages per question, optional score
    floor.  (query_id, rank, id, score)."""
    hits = retrieve_hits(queries, docs, k, min_score, fields, where)
    return top_k_per_query(hits, k).select("query_id", "rank", "id", "score")


def citation_counts(hits: DataFrame, queries: DataFrame | None = None, id_col: str = "query_id") -> DataFrame:
    """Retrieved passages per query; with ``queries`` also those without any (0)."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("passages"))
    if queries is None:
        return counts
    return (queries.select(F.col(id_col).alias("query_id")).join(counts, "query_id", "left")
            .select("query_id", F.coalesce("passages", F.lit(0).cast("long")).alias("passages")))


def facets(docs: DataFrame, fields=None, top: int = 10) -> DataFrame:
    """Value counts of facetable fields with one scan (unpivot), top values per
    field by count then value; ``content`` counts by its SHA-256, so that no
    text is shuffled.  (field, value, count, rank)."""
    fields = fields or FACETABLE
    args = ", ".join(f"'{f}', " + ("sha2(`content`, 256)" if f == "content" else f"CAST(`{f}` AS STRING)")
                     for f in fields)
    kv = docs.select(F.expr(f"stack({len(fields)}, {args}) AS (field, value)"))
    counts = kv.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("field").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# Chosen here: values that a sketch tracks per field.  Its map then has 4,096 places, and no value it lost
# occurs more than 3.5 / 4,096 of the time.
TRACKED = 3072
TRACKED_ERROR = 3.5 / 4096


def heavy_facets(docs: DataFrame, fields=None, top: int = 10) -> DataFrame:
    """Top values of fields that may have a value per document, without a shuffle by value:
    (field, value, count, rank) of the values whose counts are above the error bound of a frequent-items
    sketch, which are exactly the most frequent ones.  A value too rare to be told from the others is not
    listed, missing values are not counted; ``content`` counts by its SHA-256.

    One sketch per field and task finds the candidates (at most ``TRACKED`` a field), a second pass counts
    only these, combined in the map tasks."""
    fields = fields or FACETABLE
    args = ", ".join(f"'{f}', " + ("sha2(`content`, 256)" if f == "content" else f"CAST(`{f}` AS STRING)")
                     for f in fields)
    kv = docs.select(F.expr(f"stack({len(fields)}, {args}) AS (field, value)")).where(F.col("value").isNotNull())
    sketches = kv.groupBy("field").agg(F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("s"), F.count(F.lit(1)).alias("n"))
    found = _materialised(sketches.select("field", "n", F.explode(F.expr(f"approx_top_k_estimate(s, {TRACKED})")).alias("t"))
                          .select("field", F.col("t.item").alias("value"), "n"), "facet-candidates")
    counts = kv.join(F.broadcast(found), ["field", "value"]).groupBy("field", "value").agg(   # ≤ TRACKED rows per field
        F.count(F.lit(1)).alias("count"), F.first("n").alias("n"))
    w = Window.partitionBy("field").orderBy(F.col("count").desc(), F.col("value"))
    return (counts.where(F.col("count") > F.lit(TRACKED_ERROR) * F.col("n")).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top).select("field", "value", "count", "rank"))


# Fields the search-configuration check requires.
REQUIRED_FIELDS = ["content", "title", "file_name", "file_path"]


def index_fields_table(spark: SparkSession) -> DataFrame:
    rows = [(n, t, key, s, f, o, a) for n, t, key, s, f, o, a in INDEX_FIELDS]
    return spark.createDataFrame(
        rows, "field string, type string, key boolean, searchable boolean, filterable boolean, "
              "sortable boolean, facetable boolean")


def index_coverage(docs: DataFrame, required=REQUIRED_FIELDS) -> DataFrame:
    """Per required field: present in the schema, searchable flag, rows with a
    non-empty value and their share — one aggregate pass, unpivoted."""
    spark = docs.sparkSession
    present_cols = [f for f in required if f in docs.columns]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.coalesce(F.length(F.col(f).cast("string")) > 0, F.lit(False))).alias(f)
             for f in present_cols]
    one = docs.agg(*aggs)
    args = ", ".join(f"'{f}', `{f}`" for f in present_cols)
    filled = one.select("_rows", F.expr(f"stack({len(present_cols)}, {args}) AS (field, non_empty)"))
    req = spark.createDataFrame([(f,) for f in required], "field string")
    flags = index_fields_table(spark).select("field", "searchable")
    return (req.join(F.broadcast(flags), "field", "left")
            .join(F.broadcast(filled), "field", "left")
            .select("field",
                    F.col("non_empty").isNotNull().alias("present"),
                    F.coalesce(F.col("searchable"), F.lit(False)).alias("searchable"),
                    F.coalesce(F.col("non_empty"), F.lit(0)).cast("bigint").alias("non_empty"),
                    F.round(F.col("non_empty") / F.col("_rows"), 6).alias("share")))


def sort_by_field(docs: DataFrame, field: str) -> DataFrame:
    """Whole index ordered by a sortable field (ties on id) as ranked rows."""
    from ..plans.ordering import global_rank
    return global_rank(docs.select("id", F.col(field).alias("value")),
                       [F.col("value").asc_nulls_first(), F.col("id").asc()])


# ------------------------------------------------------------ persisted index
def write_search_index(docs: DataFrame, root: str, fields=SEARCHABLE, partitions: int | None = None,
                       numbers: DataFrame | None = None, blocks: bool = False) -> None:
    """Build once: postings partitioned by field and range-clustered by term
    and document, the documents and occurrences of every term, and the
    per-field statistics.  Everything after the postings is counted from the
    written copy, so the tokenizer runs once.  ``numbers`` (id, ord) adds the
    documents' numbers to the postings; they meet the documents before these
    become postings, unless ids repeat.  ``blocks`` writes the index for
    :func:`write_impacts`: unless ids repeat, the postings of all fields in
    runs of documents (:func:`document_runs`), which no shuffle moves."""
    fields, spark = list(fields), docs.sparkSession
    repeat = ids_repeat(docs)
    if blocks and not repeat and numbers is None:
        document_runs(docs, fields).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/postings")
        counts = _counts_by_term(_run_rows(spark, root), fields)
    else:
        if repeat:
            postings = build_postings(docs, fields, unique=False)
            postings = postings if numbers is None else postings.join(numbers, "id")
        else:
            rows = docs.select("id", *fields) if numbers is None else docs.select("id", *fields).join(numbers, "id")
            postings = row_postings(rows, fields, [] if numbers is None else ["ord"])
        write_postings(postings, f"{root}/postings", partitions)
        counts = term_counts(spark.read.parquet(f"{root}/postings"))
    counts.sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{root}/terms")
    field_stats_from_terms(spark.read.parquet(f"{root}/terms"), docs, fields).write.mode("overwrite") \
        .parquet(f"{root}/stats")


def document_runs(docs: DataFrame, fields) -> DataFrame:
    """(term, block, docs of (slot, id, tf_0, dl_0, ...)): the postings of all fields, a row for a term in a range of
    ``BLOCK_DOCS`` documents.  What a task reads at once (some ``RUN_BYTES``) is one run, sorted by term and range; its
    documents are put in ranges by length, so a range lies in one run and nothing is shuffled, sorted or spilled.
    Ids stand in the rows of ``NO_TERM``, which every range has; elsewhere a document is its place in its range."""
    spark = docs.sparkSession
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) in (None, str(2**31 - 1)):
        spark.conf.set(bound, str(RUN_BYTES))
    held = ",".join(["slot:tinyint,id:" + docs.schema["id"].dataType.simpleString(), *[f"tf_{i}:int,dl_{i}:int" for i in range(len(fields))]])
    return (docs.select("id", F.length(F.concat_ws(" ", *fields)).alias("length"), *[tokens(f).alias(f"toks_{i}") for i, f in enumerate(fields)])
            .mapInArrow(_inverter(len(fields)), f"term string, block long, docs array<struct<{held}>>"))


def _inverter(n_fields: int):
    """Rows (id, length, tokens of every field) -> rows of :func:`document_runs`, a run for every batch."""
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            order = np.argsort(batch.column(1).to_numpy(zero_copy_only=False), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lengths = [pc.fill_null(pc.list_value_length(batch.column(2 + c)), 0).to_numpy(zero_copy_only=False) for c in range(n_fields)]
            toks = [pa.array([NO_TERM] * len(order), pa.string()), *[batch.column(2 + c).flatten().cast(pa.string()) for c in range(n_fields)]]
            coded = pa.concat_arrays(toks).dictionary_encode()
            by_term = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(by_term), np.int64)
            rank[by_term] = np.arange(len(by_term))
            of = np.concatenate([place, *[np.repeat(place, size) for size in lengths]])
            key, at = np.unique((rank[coded.indices.to_numpy()] << 32) | of, return_inverse=True)
            edge = np.cumsum([0, *map(len, toks)])
            doc, term = key & 0xFFFFFFFF, key >> 32
            columns = []
            for c in range(1, n_fields + 1):
                tf = np.bincount(at[edge[c]:edge[c + 1]], minlength=len(key)).astype(np.int32)
                columns += [tf, np.where(tf > 0, lengths[c - 1][order].astype(np.int32)[doc], 0)]
            ids, part = batch.column(0).take(pa.array(order)), doc // BLOCK_DOCS
            first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(part, prepend=-1))
            names = ["slot", "id", *[f"{x}_{i}" for i in range(n_fields) for x in ("tf", "dl")]]
            for k in range(0, len(first), OUT_ROWS):
                here = first[k:k + OUT_ROWS]
                lo, hi = here[0], first[k + OUT_ROWS] if k + OUT_ROWS < len(first) else len(key)
                named = ids.take(pa.array(doc[lo:hi], mask=term[lo:hi] > 0))  # NO_TERM is the first
                slot = pa.array((doc[lo:hi] % BLOCK_DOCS).astype(np.int8))
                held = pa.StructArray.from_arrays([slot, named, *[pa.array(x[lo:hi]) for x in columns]], names)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(by_term[term[here]])), pa.array(block + part[here]),
                     pa.ListArray.from_arrays(pa.array(np.append(here - lo, hi - lo).astype(np.int32)), held)], ["term", "block", "docs"])
            block += -(-len(order) // BLOCK_DOCS)
    return run


def _run_rows(spark: SparkSession, root: str) -> DataFrame:
    """The postings of an index kept in runs."""
    return spark.read.parquet(f"{root}/postings").where(F.col("term") != NO_TERM)


def _doc(block, slot) -> Column:
    """The number of a document of an index kept in runs."""
    return F.col(block) * F.lit(BLOCK_DOCS) + F.col(slot)


def _run_ids(spark: SparkSession, root: str) -> DataFrame:
    """(doc, id) of an index kept in runs."""
    named = spark.read.parquet(f"{root}/postings").where(F.col("term") == NO_TERM).select("block", F.inline("docs"))
    return named.select(_doc("block", "slot").alias("doc"), "id")


def _counts_by_term(rows: DataFrame, fields) -> DataFrame:
    """:func:`term_counts` of an index kept in runs, combined in the map tasks."""
    per_term = rows.select("term", F.inline("docs")).groupBy("term").agg(
        *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(fields))],
        *[F.sum(f"tf_{i}").alias(f"cf_{i}") for i in range(len(fields))])
    args = ", ".join(f"'{f}', df_{i}, cf_{i}" for i, f in enumerate(fields))
    return per_term.select("term", F.expr(f"stack({len(fields)}, {args}) AS (field, df, cf)")).where(F.col("df") > 0) \
        .select("field", "term", "df", "cf")


def read_postings(spark: SparkSession, root: str, fields=SEARCHABLE) -> DataFrame:
    """(field, term, id, dl, tf, block if there) of a written index, kept by field or in runs of documents."""
    fields, kept = list(fields), spark.read.parquet(f"{root}/postings")
    if "docs" not in kept.columns:
        return kept.where(F.col("field").isin(fields))
    args = ", ".join(f"'{f}', dl_{SEARCHABLE.index(f)}, tf_{SEARCHABLE.index(f)}" for f in fields)
    flat = _run_rows(spark, root).select("term", "block", F.inline("docs")).withColumn("doc", _doc("block", "slot"))
    flat = flat.select("term", "doc", "block", F.expr(f"stack({len(fields)}, {args}) AS (field, dl, tf)")).where(F.col("tf") > 0)
    return (flat.join(_run_ids(spark, root), "doc")
            .select("field", "term", "id", "dl", F.col("tf").cast("long").alias("tf"), "block"))


def search_index(spark: SparkSession, root: str, query: str, k: int = 5, fields=SEARCHABLE,
                 where_ids: DataFrame | None = None) -> DataFrame:
    """BM25 top-k against a persisted index: reads only the postings of the
    query's terms (pushed-down ``IN`` filter, field partitions pruned), never
    re-tokenizes documents.  Same scores and ranking as :func:`bm25_search`."""
    terms = query_term_list(spark, query)
    post = read_postings(spark, root, fields).where(F.col("term").isin(terms))
    dfreq = spark.read.parquet(f"{root}/terms").where(F.col("term").isin(terms)).select("field", "term", "df")
    stats = spark.read.parquet(f"{root}/stats")
    hits = post if where_ids is None else post.join(where_ids.select("id"), "id", "left_semi")
    return rank_postings(hits, dfreq, stats, k)


def rank_postings(post: DataFrame, dfreq: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(rank, id, score): the best documents of one query's postings (field, term, id, dl, tf), given the
    document frequencies of its terms and the field statistics."""
    contrib = (post.join(F.broadcast(dfreq), ["field", "term"])     # ≤ terms × fields rows
               .join(F.broadcast(stats), "field")                    # one row per field
               .select("id", _bm25(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"),
                                   F.col("avg_dl")).alias("w")))
    scored = contrib.groupBy("id").agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score"))
    return top_k(scored, k, [F.col("score").desc(), F.col("id").asc()]).select("rank", "id", "score")


def _lengths_by_row(post: DataFrame) -> DataFrame:
    """(id, length): a document's longest field, counted in the map tasks first."""
    return post.groupBy("id").agg(F.max("dl").alias("length"))


def _df_by_term(terms: DataFrame, fields) -> DataFrame:
    """(term, dfs): the document frequencies of a term, one number a field; a row a term."""
    return terms.groupBy("term").agg(*[F.max(F.when(F.col("field") == f, F.col("df"))).alias(f"df_{i}") for i, f in enumerate(fields)])


def _impact_weights(spark: SparkSession, root: str, fields, qterms: DataFrame | None = None) -> DataFrame:
    """(term, id, block, w) from a written index.  The postings move once, by term: the frequencies meet them
    there, and the sums over the fields of a document and the bounds of a range stay in the same task."""
    fields = list(fields)
    post = read_postings(spark, root, fields)
    terms = spark.read.parquet(f"{root}/terms").where(F.col("field").isin(fields))
    stats = spark.read.parquet(f"{root}/stats")
    n_docs = stats.agg(F.max("n_docs")).first()[0] or 0  # one number
    if qterms is not None:
        only = qterms.select("term").distinct()
        post, terms = post.join(only, "term", "left_semi"), terms.join(only, "term", "left_semi")
    if "block" not in post.columns:  # an index that was not written for impacts
        blocks = (_lengths_by_row(read_postings(spark, root, fields))
                  .select("id", block_of(F.col("id"), F.col("length"), n_docs).alias("block")))
        post = post.join(blocks, "id")
    df = F.coalesce(*[F.when(F.col("field") == f, F.col(f"df_{i}")) for i, f in enumerate(fields)])
    met = post.select("field", "term", "id", "dl", "tf", "block").join(_df_by_term(terms, fields), "term").join(F.broadcast(stats), "field")
    w = _bm25(F.col("tf"), F.col("dl"), df, F.col("n_docs"), F.col("avg_dl"))
    return met.groupBy("term", "id", "block").agg(F.sum(w).alias("w"))


def write_impacts(spark: SparkSession, root: str, fields=SEARCHABLE) -> None:
    """Add to a written index, for :func:`retrieve_index`, the weight of every term in every document
    (``impacts``) and its largest weight in every range of documents (``bounds``), both clustered by term."""
    if "docs" in spark.read.parquet(f"{root}/postings").columns:
        return _write_run_impacts(spark, root, list(fields))
    weights = _impact_weights(spark, root, fields)
    weights.sortWithinPartitions("term", "block", "id").write.mode("overwrite").parquet(f"{root}/impacts")
    bounds = block_bounds(spark.read.parquet(f"{root}/impacts"))
    bounds.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{root}/bounds")


def _write_run_impacts(spark: SparkSession, root: str, fields: list[str]) -> None:
    """The same of an index kept in runs, in one table: (term, block, bound, docs of (slot, w)).  A bound is the largest
    weight, rounded up to one of ``BOUND_STEPS`` steps, which takes little room.

    Postings stay in their runs' order: the document frequencies of the most frequent terms, ``SENT_TERMS`` at most,
    are sent to the tasks that read them.  Only the postings of terms that are rarer (if there are more terms) are
    shuffled by term; a term without a frequency here occurs once."""
    rows, terms = _run_rows(spark, root), spark.read.parquet(f"{root}/terms")
    stats = {r["field"]: r for r in spark.read.parquet(f"{root}/stats").collect()}  # a row a field
    order = [SEARCHABLE.index(f) for f in fields]
    dfs = _df_by_term(terms, SEARCHABLE).withColumn("n", sum((F.coalesce(f"df_{i}", F.lit(0)) for i in range(len(SEARCHABLE))), F.lit(0)))
    dfs = _materialised(dfs.where(F.col("n") > 1).withColumn("doublings", F.floor(F.log2("n"))), "term-frequencies")
    least, room = 64, SENT_TERMS
    for r in dfs.groupBy("doublings").count().orderBy(F.desc("doublings")).collect():  # 64 at most
        room -= r["count"]
        if room < 0:
            break
        least = r["doublings"]
    common = F.broadcast(dfs.where(F.col("doublings") >= least))  # SENT_TERMS rows at most

    def weight(d):
        return sum((F.when(d[f"tf_{i}"] > 0, _saturated(F.col(f"idf_{i}"), d[f"tf_{i}"], d[f"dl_{i}"],
                                                        F.lit(stats[SEARCHABLE[i]]["avg_dl"]).cast("double"))).otherwise(F.lit(0.0))
                    for i in order), F.lit(0.0))

    def write(met, mode):
        idfs = [_idf(F.coalesce(f"df_{i}", F.lit(1)), F.lit(stats[SEARCHABLE[i]]["n_docs"])).alias(f"idf_{i}") for i in order]
        held = met.select("term", "block", "docs", *idfs).select(
            "term", "block", F.transform("docs", lambda d: F.struct(d["slot"].alias("slot"), weight(d).alias("w"))).alias("docs"))
        most = held.withColumn("most", F.array_max(F.transform("docs", lambda d: d["w"])))
        unit = F.pow(F.lit(2.0), F.floor(F.log2("most"))) / F.lit(float(BOUND_STEPS))
        bound = F.when(F.col("most") > 0, F.ceil(F.col("most") / unit) * unit).otherwise(F.col("most"))
        most.select("term", "block", bound.cast("float").alias("bound"), "docs") \
            .write.mode(mode).option("compression", "zstd").parquet(f"{root}/impacts")
    if room >= 0:  # all of them
        return write(rows.join(common, "term", "left"), "overwrite")
    write(rows.join(common, "term"), "overwrite")
    rest = rows.join(common, "term", "left_anti").join(dfs.where(F.col("doublings") < least), "term", "left")
    write(rest.sortWithinPartitions("term", "block"), "append")


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a folder of an index is there, asked of the store that holds it."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def index_hits(spark: SparkSession, root: str, queries: DataFrame, k: int = 5, min_score: float | None = None) -> DataFrame:
    """(query_id, id, score): the documents that :func:`retrieve_index` scores whole."""
    qterms = query_terms(queries)
    impacts = spark.read.parquet(f"{root}/impacts") if _written(spark, f"{root}/impacts") else None
    if impacts is not None and "docs" in impacts.columns:
        found = _run_hits(impacts, _materialised(qterms, "batch-terms"), k, min_score)
        return found.join(_run_ids(spark, root), F.col("doc") == F.col("no")).select("query_id", "id", "score")
    if impacts is None or not _written(spark, f"{root}/bounds"):
        weights = _materialised(_impact_weights(spark, root, SEARCHABLE, qterms), "batch-weights")
        return pruned_hits(weights, block_bounds(weights.repartition("block")), qterms, k, min_score)
    terms = qterms.select("term").distinct()
    weights, bounds = (t.join(terms, "term", "left_semi") for t in (impacts, spark.read.parquet(f"{root}/bounds")))
    return pruned_hits(_materialised(weights, "batch-weights"), bounds.repartition("block"), qterms, k, min_score)


def _sent(df: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it has at most ``SENT_ROWS`` rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _run_hits(impacts: DataFrame, batch: DataFrame, k: int, min_score: float | None) -> DataFrame:
    """(query_id, no, score): :func:`pruned_hits` of an index kept in runs, by the documents' numbers.  All of a document
    or range lies where its run is read, so sums are whole in the map tasks: what moves is a row for each range (or
    scored document) and query, not weights."""
    sent = _sent(batch)
    terms = _sent(_materialised(batch.select("term").distinct(), "terms-of-batch"))
    mine = impacts.join(terms, "term", "left_semi")
    weights = mine.select("term", "block", F.inline("docs")).select("term", _doc("block", "slot").alias("id"), "w")

    def whole_scores(pairs, weights, qterms):
        return (weights.join(_sent(pairs), "id").join(sent, ["query_id", "term"]).groupBy("query_id", "id")
                .agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))
    blocks = _materialised(open_blocks(weights, mine.select("term", "block", "bound"), sent, k, min_score, whole_scores), "open-blocks")
    met = impacts.join(_sent(blocks), "block").join(sent, ["query_id", "term"]).select("query_id", "block", F.inline("docs"))
    hits = (met.groupBy("query_id", _doc("block", "slot").alias("no")).agg(F.round(F.sum("w"), SCORE_DIGITS).alias("score")))
    return hits if min_score is None else hits.where(F.col("score") >= F.lit(min_score))


def retrieve_index(spark: SparkSession, root: str, queries: DataFrame, k: int = 5,
                   min_score: float | None = None) -> DataFrame:
    """Batch retrieval against a persisted index: only the stored weights and bounds of the batch's terms are
    read; of an index without impacts, the postings of these terms.  Same results as :func:`retrieve_batch`."""
    hits = index_hits(spark, root, queries, k, min_score)
    return top_k_per_query(hits, k).select("query_id", "rank", "id", "score")
