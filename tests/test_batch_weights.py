"""Batch retrieval tokenizes its documents once and moves their matching terms once."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import search as se
from quarry.plans import fixtures as fx
from tests.conftest import SF_SMALL


def _weights(docs, terms):
    """(term, id): weight, by a plain loop over postings (field, term, id, length)."""
    post, lengths = Counter(), {f: [] for f in se.SEARCHABLE}
    for d in docs:
        for f in se.SEARCHABLE:
            toks = None if d[f] is None else re.findall(r"[^\W_]+", d[f].lower())
            if toks is not None:
                lengths[f].append(len(toks))
                post.update((f, t, d["id"], len(toks)) for t in toks if t in terms)
    df, out = Counter((f, t) for f, t, _, _ in post), Counter()
    for (f, t, i, dl), tf in post.items():
        idf = math.log(1 + (len(docs) - df[f, t] + 0.5) / (df[f, t] + 0.5))
        norm = tf + 1.2 * (0.25 + 0.75 * dl / (sum(lengths[f]) / len(lengths[f])))
        out[t, i] += idf * tf * 2.2 / norm
    return out


def test_weights_of_unique_and_repeated_ids(spark):
    fields = "id string, content string, title string, file_name string"
    rows = [("a", "red fox red", "fox", "x.pdf"), ("b", None, "red", None), ("c", "", None, "red.pdf"), ("d", "hen", "hen", "pdf")]
    queries = spark.createDataFrame([(1, "Red fox"), (2, "pdf none")], "query_id long, query string")
    for data in (rows, [*rows, ("a", "red fox red", "hen", "fox fox"), ("a", "fox", "fox", None)]):
        docs = spark.createDataFrame(data, fields)
        got = {(r["term"], r["id"]): r["w"] for r in se.batch_weights(docs, se.query_terms(queries)).collect()}
        want = _weights([dict(zip(("id", "content", "title", "file_name"), r, strict=True)) for r in data], {"red", "fox", "pdf", "none"})
        assert got.keys() == want.keys()
        assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_texts_are_tokenized_once(spark, monkeypatch):
    plans, whole = [], se._materialised

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return whole(df, name)
    monkeypatch.setattr(se, "_materialised", noted)
    queries = fx.queries_table(spark, SF_SMALL)
    docs = fx.docs(spark, SF_SMALL).withColumn("content", F.concat(F.col("content"), F.lit(" MARKED")))
    se.batch_weights(docs, se.query_terms(queries))
    assert sum(p.count("MARKED") and p.count("stack(") for p in plans) == 1
    assert sum(p.count("RepartitionByExpression") for p in plans) == 1
