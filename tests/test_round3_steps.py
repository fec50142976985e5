"""Steps that findings of round 3 named: what they move, and the same results on odd rows."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators import search as se
from quarry.plans import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _docs(spark, rows):
    return spark.createDataFrame([(*r, f"{r[0]}.txt") for r in rows], "id string, content string, title string, file_name string")


def test_postings_of_keys_are_not_shuffled(spark):
    plan = _plan(ix.build_postings(fx.docs(spark, SF_SMALL)))
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert plan.count("regexp_extract_all") == 1  # each text is tokenized once


def test_postings_equal_token_rows_also_for_repeated_ids(spark):
    once = _docs(spark, [("a", "x y x z, x!", "T x"), ("b", "", None), (None, "Été x", "t"), ("c", None, "")])
    again = once.unionByName(_docs(spark, [("a", "x q q", "T x"), ("a", "x y x z, x!", None), (None, "x x", "t")]))
    for docs in (once, again, once.limit(0)):
        want = ix.tokenize(docs).groupBy("field", "term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        got = ix.build_postings(docs)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_an_index_replaces_the_one_before(spark, scratch):
    se.write_search_index(_docs(spark, [("a", "old words", "one")]), f"{scratch}/i")
    se.write_search_index(_docs(spark, [("b", "new words", None)]), f"{scratch}/i")
    post = spark.read.parquet(f"{scratch}/i/postings")
    assert {(r["field"], r["term"], r["id"]) for r in post.collect()} == {
        ("content", "new", "b"), ("content", "words", "b"), ("file_name", "b", "b"), ("file_name", "txt", "b")}


def test_alarm_calls_a_group_once_a_batch(spark, scratch):
    import datetime as dt

    from quarry.streaming import jobs as sj
    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("run_id"), F.lit(dt.datetime(2024, 1, 1)).alias("ts"),
                                 F.when(F.col("id") % 5 == 0, "Failed").otherwise("Running").alias("status"),
                                 F.lit(None).cast("string").alias("runStatus"), F.col("id").alias("event_id"))
    last = rows.where("run_id = 'r0'").withColumn("ts", F.lit(dt.datetime(2024, 1, 2)))
    for k, part in enumerate((rows, last)):
        part.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{scratch}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    q = sj.stream_run_alarm(stream, f"{scratch}/sink", f"{scratch}/ckpt", "1 minute", keep_s=3600)
    q.awaitTermination()
    got = sj.read_run_alarm(spark, f"{scratch}/sink")
    assert got.count() == got.select("run_id").distinct().count() == n - n // 5
    # a state of its own for every run would be n rows
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= sj.ALARM_GROUPS


def test_config_layers_are_dealt_out_before_they_grow(spark):
    from quarry.operators import governance as gv
    layers = fx.config_layers(spark, SF_SMALL)
    assert layers.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # the table is one file
    assert _plan(gv.resolve_config(layers)).count("Exchange") == 1


def test_own_runs_write_pages_by_many_tasks(spark, scratch, monkeypatch):
    from quarry.plans import catalog_streaming as cs
    for t in ("documents", "pages"):
        fx.table(spark, SF_SMALL, t).repartition(6).write.parquet(f"{scratch}/in/{t}.parquet")
    monkeypatch.setattr(cs, "scratch_path", lambda spark, name: f"{scratch}/own")
    report = {r["indexer"]: r for r in cs.q_run_report_own(spark, f"{scratch}/in").collect()}
    assert report["pages"]["runs"] == cs.WAVES and report["pages"]["total_processed"] == fx.table(spark, SF_SMALL, "pages").count()
    assert len(spark.read.parquet(f"{scratch}/own/pages").inputFiles()) > cs.WAVES  # one task a wave read the whole table before


def test_impacts_move_postings_once_and_answer_alike(spark, scratch):
    docs = _docs(spark, [(f"d{i:02d}", f"red fox {'dog ' * (i % 4)}w{i}", "red" if i % 3 else None) for i in range(60)])
    queries = spark.createDataFrame([(1, "red dog"), (2, "fox w7"), (3, "none")], "query_id int, query string")
    for name, rows in (("once", docs), ("again", docs.unionByName(docs.limit(5)))):
        se.write_search_index(rows, f"{scratch}/{name}", blocks=True)
        plain = sorted(map(tuple, se.retrieve_index(spark, f"{scratch}/{name}", queries, 3).collect()))
        weights = se._impact_weights(spark, f"{scratch}/{name}", se.SEARCHABLE)
        se.write_impacts(spark, f"{scratch}/{name}")
        assert sorted(map(tuple, se.retrieve_index(spark, f"{scratch}/{name}", queries, 3).collect())) == plain
        assert plain == sorted(map(tuple, se.retrieve_batch(queries, rows, 3).collect()))
        if name == "once":
            assert "Window" not in _plan(weights)  # lengths are not looked up among all postings


def test_streamed_postings_are_not_shuffled(spark, scratch, monkeypatch):
    from quarry.streaming import index as si
    plans = []
    build = si.build_postings

    def seen(docs, fields, **how):
        out = build(docs, fields, **how)
        plans.append(_plan(out))
        return out
    monkeypatch.setattr(si, "build_postings", seen)
    docs = fx.docs(spark, SF_SMALL)
    docs.write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{scratch}/in")
    si.stream_index(stream, f"{scratch}/i", f"{scratch}/ckpt").awaitTermination()
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
