"""An index for impacts keeps postings in runs of documents: whole, not moved, and with the same answers."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import search as se
from quarry.plans import fixtures as fx
from tests.conftest import SF_SMALL

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, f"{r[0]}.txt") for r in rows], "id string, content string, title string, file_name string")


@pytest.fixture()
def short_runs(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "7")
    yield
    spark.conf.set(ROWS, before)


def _key(r):
    return tuple(str(x) for x in r)


def test_postings_in_runs_are_whole_and_not_moved(spark, scratch, short_runs):
    odd = _docs(spark, [(f"d{i:02d}", None if i % 9 == 4 else f"Été fox {'dog ' * (i % 5)}w{i}", "fox red" if i % 3 else None) for i in range(40)]
                + [(None, "fox x", ""), ("empty", "", " .")])
    for name, docs in (("odd", odd), ("sf", fx.docs(spark, SF_SMALL)), ("none", odd.limit(0))):
        se.write_search_index(docs, f"{scratch}/{name}", blocks=True)
        cols = ["field", "term", "id", "dl", "tf"]
        got, want = se.read_postings(spark, f"{scratch}/{name}").select(*cols), ix.build_postings(docs).select(*cols)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(_key, got.collect())) == sorted(map(_key, want.collect()))
        terms = spark.read.parquet(f"{scratch}/{name}/terms")
        assert sorted(map(_key, terms.collect())) == sorted(map(_key, ix.term_counts(want).select(*terms.columns).collect()))
    buf = io.StringIO()
    with redirect_stdout(buf):
        se.document_runs(fx.docs(spark, SF_SMALL), se.SEARCHABLE).explain()
    assert "Exchange" not in buf.getvalue() and "Sort" not in buf.getvalue()


@pytest.mark.parametrize("sent_terms, sent_rows", [(1 << 19, 1 << 20), (3, 1 << 20), (0, 0)])
def test_runs_answer_like_the_whole_batch(spark, scratch, short_runs, monkeypatch, sent_terms, sent_rows):
    monkeypatch.setattr(se, "SENT_TERMS", sent_terms)
    monkeypatch.setattr(se, "SENT_ROWS", sent_rows)
    docs = _docs(spark, [(f"d{i:02d}", f"red fox {'dog ' * (i % 4)}w{i} {'cat ' * (i % 7)}", "red" if i % 3 else None) for i in range(60)])
    queries = spark.createDataFrame([(1, "red dog"), (2, "fox w7 cat"), (3, "none"), (4, "")], "query_id int, query string")
    se.write_search_index(docs, f"{scratch}/i", blocks=True)
    se.write_impacts(spark, f"{scratch}/i")
    for floor in (None, 0.5):
        want = sorted(map(tuple, se.retrieve_batch(queries, docs, 3, floor).collect()))
        assert want and sorted(map(tuple, se.retrieve_index(spark, f"{scratch}/i", queries, 3, floor).collect())) == want
    for q in ("red dog", "w7 txt", "none"):
        assert se.search_index(spark, f"{scratch}/i", q, 5).collect() == se.bm25_search(docs, q, 5).collect()
    impacts = spark.read.parquet(f"{scratch}/i/impacts").select("bound", F.array_max(F.transform("docs", lambda d: d["w"])).alias("w"))
    assert all(r["w"] <= r["bound"] <= r["w"] * (1 + 2 / se.BOUND_STEPS) for r in impacts.collect())
    plain = se._impact_weights(spark, f"{scratch}/i", se.SEARCHABLE).groupBy("term", "block").agg(F.max("w").alias("w"))
    assert impacts.count() == plain.count()


def test_an_index_replaces_one_of_the_other_kind(spark, scratch):
    for first in (True, False):
        for blocks in (first, not first):
            se.write_search_index(_docs(spark, [("a" if blocks else "b", "old words", "one")]), f"{scratch}/i", blocks=blocks)
            got = {r["id"] for r in se.read_postings(spark, f"{scratch}/i").collect()}
            assert got == {"a" if blocks else "b"}
