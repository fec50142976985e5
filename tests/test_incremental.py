"""Streams that alarm and index as they run, bound-pruned retrieval, bitmap filters, stored profiles and
reference closures against plain versions."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from quarry.operators import bitmaps as bm
from quarry.operators import index as ix
from quarry.operators import lookups as lk
from quarry.operators import paging as pg
from quarry.operators import profiles as pf
from quarry.operators import search as se
from quarry.plans import fixtures as fx
from quarry.sources import files as sf
from quarry.sources import reports as rp
from quarry.streaming import index as si
from quarry.streaming import jobs as sj
from tests.conftest import SF_CHECK, SF_SMALL

EVENTS = "run_id long, event_id long, ts timestamp_ntz, status string, runStatus string"


def event(run, eid, minute, status=None, run_status=None):
    import datetime as dt
    return (run, eid, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), status, run_status)


def deliver(spark, path, waves):
    for rows in waves:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_alarm_comes_once_and_respects_late_closings(spark, scratch):
    path, sink, ckpt = f"{scratch}/in", f"{scratch}/sink", f"{scratch}/ckpt"

    def drain():
        stream = spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).option("maxFilesPerTrigger", 1).parquet(path)
        sj.stream_run_alarm(stream, sink, ckpt, "30 minutes").awaitTermination()
        return sorted((r["run_id"], r["first_ts"].minute) for r in sj.read_run_alarm(spark, sink).collect())
    deliver(spark, path, [
        [event(1, 1, 0, "Running"), event(2, 2, 0, "Running"), event(3, 3, 5, None, "Queued"), event(4, 4, 4, "Running"), event(None, 5, 0, "Running")],
        [event(2, 6, 14, "Succeeded"), event(9, 7, 30, "Running")],
        # a late closing of run 3 within the wait, a late first event that moves run 4's due time back
        [event(3, 8, 20, "Failed"), event(4, 9, 2, "Running"), event(4, 10, 18, "Succeeded"), event(9, 11, 45, "Running")],
        [event(9, 12, 90, "Running")]])
    # 1 never closes, 4 closes 16 minutes after its first event, 9 is due at 45 < 90 - 30
    assert drain() == [(1, 0), (4, 2), (9, 30)]
    assert drain() == [(1, 0), (4, 2), (9, 30)]  # a restart adds nothing
    # events of judged runs raise no second alarm; a new run does, when the watermark has passed
    deliver(spark, path, [[event(1, 13, 95, "Running"), event(5, 14, 96, "Running")], [event(6, 15, 300, "Succeeded")],
                          [event(7, 16, 400, "Succeeded")]])
    assert drain() == [(1, 0), (4, 2), (5, 36), (9, 30)]


def rows_of(spark, rows):
    import datetime as dt
    data = [(i, c, t, f"{i}.txt", f"a/{i}.txt", None if d is None else dt.datetime(2024, 1, d), 1) for i, c, t, d in rows]
    return spark.createDataFrame(data, "id string, content string, title string, file_name string, file_path string, "
                                       "last_modified timestamp_ntz, file_size long")


def test_stream_index_equals_a_rebuild_and_replays_change_nothing(spark, scratch):
    waves = [[("a", "red fox red", "one", 1), ("b", "blue fox", None, 1), ("c", None, "three", 1)],
             [("a", "green cat", "one", 2), ("b", "old news", "x", None), ("d", "", "four", 1), ("d", "fox", "four", 3)],
             [("a", "red dog", "one", 2), ("c", "fox and dog", "three", 1)], [("d", None, None, 4), ("e", "fox", "five", 1)]]
    root = f"{scratch}/index"
    first = rows_of(spark, waves[0])
    first.write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(first.schema).parquet(f"{scratch}/in")
    si.stream_index(stream, root, f"{scratch}/ckpt").awaitTermination()

    def state():
        post = si.delta_postings(spark.read.parquet(f"{root}/postings"))
        return ({tuple(r) for r in post.select("field", "term", "id", "dl", "tf").collect()},
                {tuple(r) for r in si.delta_corpus_stats(spark, root).collect()},
                [tuple(r) for r in si.search_deltas(spark, root, "red fox dog", k=4).collect()])
    for n, wave in enumerate(waves[1:], 1):
        for _ in range(2):  # every batch is delivered twice
            si._write_batch(rows_of(spark, wave), n, root, list(ix.SEARCHABLE))
            got = state()
            docs = si.read_index_rows(spark, root)
            post = ix.build_postings(docs)
            assert got[0] == {tuple(r) for r in post.select("field", "term", "id", "dl", "tf").collect()}
            assert got[1] == {tuple(r) for r in ix.corpus_stats(docs, post).select("field", "term", "df", "n_docs", "avg_dl").collect()}
            assert got[2] == [tuple(r) for r in se.bm25_search(docs, "red fox dog", k=4).collect()]
    current = {r["id"]: r["content"] for r in si.read_index_rows(spark, root).collect()}
    assert current == {"a": "red dog", "b": "blue fox", "c": "fox and dog", "d": None, "e": "fox"}
    si.compact_index(spark, root, f"{scratch}/built")
    assert [tuple(r) for r in se.search_index(spark, f"{scratch}/built", "red fox dog", k=4).collect()] == state()[2]


@pytest.mark.parametrize("k, floor", [(5, None), (1, None), (40, 20.0)])
def test_pruned_retrieval_gives_all_best_rows(spark, k, floor):
    docs, queries = fx.docs(spark, SF_CHECK), fx.queries_table(spark, SF_CHECK)
    every = se.batch_hits(docs, queries).cache()
    want = se.top_k_per_query(every if floor is None else every.where(F.col("score") >= floor), k)
    got = se.retrieve_batch(queries, docs, k=k, min_score=floor)
    key = ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    if k == 5:
        scored = se.retrieve_hits(queries, docs, k=k).count()
        assert scored < 0.4 * every.count()  # 0.25 of all pairs at ten times the documents
    every.unpersist()


def test_pruned_retrieval_keeps_ties(spark):
    rows = [(f"d{i:02d}", "alpha beta" if i % 2 else "gamma alpha", None, 1) for i in range(40)]
    docs = rows_of(spark, rows)
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "nothing here"), (4, ""), (5, None)], "query_id int, query string")
    got = se.retrieve_batch(queries, docs, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in got) == [
        (1, 1, "d00"), (1, 2, "d01"), (1, 3, "d02"), (2, 1, "d00"), (2, 2, "d01"), (2, 3, "d02")]


def test_bitmap_conditions(spark, scratch):
    docs = rows_of(spark, [(f"d{i:03d}", f"word w{i % 7}", None, 1 + i % 9) for i in range(300)])
    docs = docs.withColumn("file_name", F.when(F.col("last_modified").isNotNull(), F.col("file_name")))
    filters = {"day": F.date_format("last_modified", "dd"), "seven": F.regexp_extract("content", "w([0-9])", 1),
               "odd": F.when(F.substring("id", -1, 1).isin(*"13579"), "odd")}
    bm.write_filtered_index(docs, scratch, filters)
    v = F.col("value")
    day, seven, odd = bm.Has("day", v <= "04"), bm.Has("seven", v.isin("1", "5")), bm.Has("odd", v == "odd")
    flat = docs.select("id", *[c.alias(f) for f, c in filters.items()])
    holds = {"day": F.col("day") <= "04", "seven": F.col("seven").isin("1", "5"), "odd": F.coalesce(F.col("odd") == "odd", F.lit(False))}
    for where, plain in ((day, holds["day"]), (~odd, ~holds["odd"]), (bm.Both((day, seven, ~odd)), holds["day"] & holds["seven"] & ~holds["odd"]),
                         (~bm.Either((day, bm.Both((seven, odd)))), ~(holds["day"] | (holds["seven"] & holds["odd"]))),
                         (bm.Has("day", v == "99"), F.lit(False))):
        want = {r["id"] for r in flat.where(plain).collect()}
        hits = bm.search_matching(spark, scratch, "word", where, k=1000)
        assert {r["id"] for r in hits.collect()} == want
        assert bm.count_matching(spark, scratch, where).first()["documents"] == len(want)
    buf = io.StringIO()
    with redirect_stdout(buf):
        bm.search_matching(spark, scratch, "word", bm.Both((day, ~odd))).explain("formatted")
    assert "content:string" not in buf.getvalue() and "/bitmaps" in buf.getvalue()


def test_profiles_of_changed_partitions(spark, scratch):
    df = spark.createDataFrame([(i % 3 if i % 10 else None, i, float(i), f"s{i % 50}", [i]) for i in range(3000)],
                               "p int, a long, b double, c string, d array<int>")
    pf.write_states(pf.profile_states(df, "t", F.col("p")), scratch)
    changed = df.where("p = 1").withColumn("a", F.col("a") + 10_000)
    pf.write_states(pf.profile_states(changed, "t", F.col("p")), scratch)
    now = df.where("p is null or p != 1").unionByName(changed)
    for scope, part in ((F.lit(True), F.lit(True)), (F.col("part").isin("1", "2"), F.col("p").isin(1, 2))):
        merged = pf.with_accuracy(pf.merge_states(pf.read_states(spark, scratch).where(scope)), {"t": now.where(part)})
        rows = {r["column"]: r for r in merged.collect()}
        plain = now.where(part)
        assert rows["a"]["rows"] == plain.count() and rows["p"]["nulls"] == plain.where("p is null").count()
        assert (rows["a"]["min_num"], rows["a"]["max_num"]) == tuple(plain.agg(F.min("a"), F.max("a")).first())
        assert all(rows[c]["distinct_ok"] for c in "abc") and rows["a"]["quartiles_ok"] and rows["b"]["quartiles_ok"]
        assert rows["d"]["distinct_approx"] is None and rows["c"]["q50"] is None


def test_closure_ends_on_cycles(spark):
    refs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "d"), (None, "a"), ("x", None)],
                                 "name string, uses string")
    targets = spark.createDataFrame([("a",), ("z",), (None,)], "name string")
    got = lk.dependent_closure(refs, targets).collect()
    assert sorted((r["target"], r["name"], r["depth"], r["path"]) for r in got) == [
        ("a", "b", 1, "a > b"), ("a", "c", 2, "a > b > c"), ("a", "d", 2, "a > b > d"), ("a", "e", 3, "a > b > d > e")]
    with pytest.raises(RuntimeError):
        lk.dependent_closure(refs, targets, max_depth=2)


def test_heavy_facets_list_what_facets_list(spark):
    docs = fx.docs(spark, SF_SMALL)
    plain = {(r["field"], r["value"], r["count"], r["rank"]) for r in se.facets(docs).collect() if r["count"] > 1 and r["value"] is not None}
    heavy = {tuple(r) for r in se.heavy_facets(docs).select("field", "value", "count", "rank").collect()}
    assert {h for h in heavy if h[2] > 1} == plain


def test_pages_concatenate_to_the_sort(spark, scratch):
    rows = [(f"k{i:03d}", None if i % 13 == 0 else (i * 37) % 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "id string, n int")
    pg.write_sorted(docs, scratch, "n", partitions=16)
    want = [r["id"] for r in docs.orderBy(F.col("n").asc_nulls_first(), "id").collect()]
    files = spark.read.parquet(f"{scratch}/bounds").count()
    got, last = [], None
    while True:
        read = pg.page_files(spark, scratch, 30, last)
        assert len(read) <= 4 < files
        page = pg.page_after(spark, scratch, "n", 30, last).orderBy("position").collect()
        if not page:
            break
        assert [r["position"] for r in page] == list(range(1, len(page) + 1))
        got += [r["id"] for r in page]
        last = (page[-1]["n"], page[-1]["id"])
    assert got == want
    pg.write_sorted(docs.limit(0), f"{scratch}/none", "n")
    assert pg.page_after(spark, f"{scratch}/none", "n", 5).isEmpty()


def test_variant_listings(spark, scratch):
    rows = [(1, '{"value": [{"id": "a", "displayName": "A"}, {"objectId": 7, "name": "B"}]}'), (2, '[{"id": "c"}, 5, null]'), (3, '{"id": "d", "name": "D"}'),
            (4, '{"value": ['), (5, None), (6, '{"value": []}'), (7, '{"other": 1}'), (8, '{"items": [{"id": true}]}')]
    path = f"{scratch}/v"
    sf.parse_variants(spark.createDataFrame(rows, "page int, json string")).write.parquet(path)
    stored = spark.read.parquet(path)
    got = sorted(((r["page"], r["position"], r["id"], r["name"], r["broken"]) for r in sf.variant_items(stored, ["page"]).collect()), key=str)
    assert got == sorted([(1, 0, "a", "A", False), (1, 1, "7", "B", False), (2, 0, "c", None, False), (2, 1, None, None, False), (2, 2, None, None, False),
                          (3, 0, "d", "D", False), (4, None, None, None, True), (8, 0, "true", None, False)], key=str)
    schema = sf.variant_schema(stored).first()
    assert (schema["documents"], schema["broken"]) == (8, 1) and "VARIANT" in schema["schema"]


def test_reports_count_what_was_written(spark, scratch):
    docs = rows_of(spark, [(f"d{i}", "x" * i, None, 1) for i in range(50)])
    rp.reported(docs, lambda d: d.write.parquet(f"{scratch}/out"), "job", f"{scratch}/runs", rejected=F.length("content") > 39, size=F.length("content"))
    run = rp.read_runs(spark, f"{scratch}/runs").first()
    assert (run["status"], run["itemsProcessed"], run["itemsFailed"], run["bytes"]) == ("success", 40, 10, sum(range(40)))
    assert spark.read.parquet(f"{scratch}/out").count() == 40
    with pytest.raises(Exception):
        rp.reported(docs, lambda d: d.write.parquet(f"{scratch}/out"), "job", f"{scratch}/runs")  # the folder is there
    states = {r["status"]: r["n"] for r in rp.read_runs(spark, f"{scratch}/runs").groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert states == {"success": 1, "error": 1}
