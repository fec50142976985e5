"""The streamed index takes back postings by the terms kept with the rows; stored postings are not read for it."""

import os
from collections import Counter

from quarry.operators import index as ix
from quarry.streaming import index as si

FIELDS = "id string, content string, title string, file_name string, file_path string, last_modified timestamp_ntz, file_size long"


def _rows(spark, data):
    return spark.createDataFrame([(i, c, t, None, None, None, 1) for i, c, t in data], FIELDS)


def test_rows_bear_their_postings(spark):
    docs = _rows(spark, [("a", "Red red fox", None), ("b", None, ""), ("c", "hen", "hen hen")])
    terms = ix.build_postings(ix.with_terms(docs), unique=True)
    assert terms.columns == ix.build_postings(docs, unique=True).columns
    assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, ix.build_postings(docs, unique=True).collect()))


def test_replaced_postings_come_from_the_rows(spark, scratch, monkeypatch):
    read, stored = [], type(spark.read).parquet

    def noted(self, *paths, **how):
        read.extend(paths)
        return stored(self, *paths, **how)
    root, split = f"{scratch}/i", spark.conf.get(si._SPLIT)
    os.mkdir(f"{scratch}/in")
    si.stream_index(spark.readStream.schema(_rows(spark, []).schema).parquet(f"{scratch}/in"), root, f"{scratch}/ckpt").awaitTermination()
    si._write_batch(_rows(spark, [("a", "red fox", "one"), ("b", "hen", None)]), 0, root, list(ix.SEARCHABLE))
    monkeypatch.setattr(type(spark.read), "parquet", noted)
    si._write_batch(_rows(spark, [("a", "red dog", "two")]), 1, root, list(ix.SEARCHABLE))
    assert f"{root}/postings" not in read and f"{root}/rows" in read
    assert spark.conf.get(si._SPLIT) == split
    got = Counter((r["field"], r["term"], r["id"], r["tf"]) for r in si.delta_postings(spark.read.parquet(f"{root}/postings")).collect())
    assert got == Counter([("content", "red", "a", 1), ("content", "dog", "a", 1), ("title", "two", "a", 1), ("content", "hen", "b", 1)])
    assert ix.TERMS not in si.read_index_rows(spark, root).columns
