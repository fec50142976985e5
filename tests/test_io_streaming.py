"""File sources and sinks, and streaming final-state / restart behaviour."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions.formats import PAIR_PREFIX_WORKSPACE
from quarry.operators import index as ix
from quarry.operators import runs as rn
from quarry.plans import fixtures as fx
from quarry.sources import files as fs
from quarry.sources import sinks
from quarry.streaming import jobs as sj
from tests.conftest import SF_SMALL


def test_scan_documents_filters_and_metadata(spark, scratch):
    os.makedirs(f"{scratch}/docs/sub", exist_ok=True)
    for name, body in [("a.pdf", "alpha"), ("sub/b.DOCX", "beta"), ("c.png", "img"), ("d.txt", "no"),
                       ("e.Pdf", "eps"), ("sub/f.DocX", "phi")]:
        with open(f"{scratch}/docs/{name}", "w") as fh:
            fh.write(body)
    got = fs.scan_documents(spark, f"{scratch}/docs", as_text=True).orderBy("metadata_storage_name").collect()
    assert [r.metadata_storage_name for r in got] == ["a.pdf", "b.DOCX", "e.Pdf", "f.DocX"]
    assert [r.content for r in got] == ["alpha", "beta", "eps", "phi"]
    assert got[0].metadata_storage_size == 5
    raw = fs.scan_documents(spark, f"{scratch}/docs").where("metadata_storage_name = 'a.pdf'").first()
    assert bytes(raw.content) == b"alpha"
    idx = ix.map_fields(fs.scan_documents(spark, f"{scratch}/docs", as_text=True))
    assert idx.columns == [f[0] for f in ix.INDEX_FIELDS]


def test_scan_pairs_file(spark, scratch):
    with open(f"{scratch}/a.env", "w") as fh:
        fh.write('A=1\nB="x=y"\nC="abc\nD=de"\n\nA=2\n')
    rest = {"B": "x=y", "C": "abc", "D": "de"}
    got = {r.key: r.value for r in fs.scan_pairs(spark, f"{scratch}/a.env").collect()}
    assert got == {"A": "2", **rest}
    got = {r.key: r.value for r in fs.scan_pairs(spark, f"{scratch}/a.env", keep="first").collect()}
    assert got == {"A": "1", **rest}


def test_scan_listing_file(spark, scratch):
    with open(f"{scratch}/l1.json", "w") as fh:
        json.dump({"value": [{"id": "1", "displayName": "A"}, {"id": "2", "displayName": "B"}]}, fh, indent=2)
    with open(f"{scratch}/l2.json", "w") as fh:
        json.dump({"domains": [{"id": "3"}]}, fh)
    rows = fs.scan_listing(spark, f"{scratch}/l1.json").collect()
    assert [(r.id, r.displayName) for r in rows] == [("1", "A"), ("2", "B")]
    assert fs.scan_listing(spark, f"{scratch}/l2.json").count() == 0
    assert fs.scan_listing(spark, f"{scratch}/l2.json", envelope="domains").count() == 1


def test_write_index_layers_exports(spark, scratch):
    docs = fx.docs(spark, SF_SMALL)
    sinks.write_index(docs, f"{scratch}/index", partitions=4)
    back = spark.read.parquet(f"{scratch}/index")
    assert back.count() == docs.count()
    assert back.schema["id"].metadata["key"] is True
    paths = sinks.write_layers(docs, f"{scratch}/lake")
    gold = spark.read.parquet(paths["gold"])
    silver = spark.read.parquet(paths["silver"])
    assert gold.agg(F.sum("documents")).first()[0] == silver.count()
    sinks.export_pairs(fx.workspaces(spark, SF_SMALL), f"{scratch}/env", PAIR_PREFIX_WORKSPACE, "displayName", "id")
    sinks.export_pairs(fx.workspaces(spark, SF_SMALL), f"{scratch}/env", PAIR_PREFIX_WORKSPACE, "displayName", "id",
                       mode="append")
    pairs = fs.parse_pairs(spark.read.text(f"{scratch}/env").select(
        F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line")))
    assert pairs.count() == fx.workspaces(spark, SF_SMALL).count()


def test_write_telemetry_roundtrip(spark, scratch):
    tel = fx.telemetry(spark, SF_SMALL)
    recs = sinks.write_telemetry(tel, f"{scratch}/tel", fx.now_lit())
    back = spark.read.json(f"{scratch}/tel")
    assert back.count() == tel.count()
    assert back.where(F.col("Timestamp").isNull()).count() == 0
    assert recs.where(F.col("bytes") <= 0).count() == 0


def test_export_pairs_keeps_names_and_adds_the_default(spark):
    df = spark.createDataFrame([("sales-eu", 1), ("sales_eu", 2), ("bronze", 3)], "name string, id long")
    lines = [r.line for r in sinks.pair_lines(df, "LAKE", "name", "id", "bronze").collect()]
    assert sorted(lines) == ["LAKE_ID=3", "LAKE_bronze_ID=3", "LAKE_sales-eu_ID=1", "LAKE_sales_eu_ID=2"]


def _batches(spark, sink):
    return spark.read.parquet(sink).where("batch_id >= 0").select("batch_id").distinct().count()


def test_stream_restart_adds_nothing(spark):
    from quarry.plans.catalog_streaming import WAVES, event_waves
    sink, ckpt = sj.run_folder(spark, "restart")
    waves = event_waves(spark, SF_SMALL)
    for _ in range(2):
        sj.stream_latest_state(fx.status_events_from(waves), sink, ckpt).awaitTermination()
    assert _batches(spark, sink) >= WAVES
    final = sj.read_latest_state(spark, sink)
    batch = rn.latest_state(fx.status_events(spark, SF_SMALL))
    assert final.select("run_id", "state").exceptAll(batch.select("run_id", "state")).count() == 0
    assert final.count() == batch.count()


def test_stream_stalled_runs_brute_force(spark):
    from quarry.plans.catalog_streaming import event_waves
    sink, ckpt = sj.run_folder(spark, "stalled-test")
    sj.stream_stalled_runs(fx.status_events_from(event_waves(spark, SF_SMALL)), sink, ckpt).awaitTermination()
    rows = sj.read_stalled_runs(spark, sink, limit_s=900).collect()
    got = {r.run_id: r.state for r in rows}
    assert len(got) == len(rows)  # one row a run
    # brute force over the same events in pandas: last state per run by (ts, event_id),
    # stalled when not terminal and first_ts + 900 s < max event time
    ev = fx.status_events(spark, SF_SMALL).toPandas()
    ev["state"] = ev["status"].fillna(ev["runStatus"])
    wm = ev["ts"].max()
    want = {}
    for run_id, g in ev.sort_values(["ts", "event_id"]).groupby("run_id"):
        last = g.iloc[-1]["state"]
        if last not in rn.TERMINAL_STATES and g["ts"].min() + pd.Timedelta(seconds=900) < wm:
            want[run_id] = last
    assert got == want


def test_stream_state_over_batches(spark, scratch):
    """A closed run stays closed when an old event of it comes late; a run that closes in a later batch
    is not reported; a batch of other runs brings nothing back."""
    schema = "event_id long, ts timestamp_ntz, run_id long, status string, runStatus string"
    day = "2024-01-01 0{}:00:00"
    batches = [[(1, day.format(1), 1, "Running", None), (2, day.format(1), 2, "Running", None)],
               [(3, day.format(2), 1, None, "Succeeded")],
               [(4, day.format(3), 3, "Running", None), (5, "2024-01-01 00:30:00", 1, "Running", None)],
               [(6, day.format(9), 4, "Succeeded", None)]]
    src = f"{scratch}/events"
    for rows in batches:
        df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string"))
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink, ckpt = sj.run_folder(spark, "state-test")
    sj.stream_stalled_runs(stream, sink, ckpt).awaitTermination()
    assert _batches(spark, sink) >= 4
    assert sorted(r.run_id for r in sj.read_stalled_runs(spark, sink, limit_s=900).collect()) == [2, 3]
    states = {r.run_id: (r.state, str(r.first_ts)) for r in sj.read_latest_state(spark, sink).collect()}
    assert states[1] == ("Succeeded", "2024-01-01 00:30:00")


def test_extract_text_matches_python(spark):
    import html
    import re

    from quarry.functions import text as tx
    pages = fx.table(spark, SF_SMALL, "pages")
    got = {r.page_id: (r.title, r.text) for r in tx.extract_fields(pages).select("page_id", "title", "text").collect()}

    def py_text(h):
        h = re.sub(r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ", h)
        h = re.sub(r"(?s)<[^>]*>", " ", h)
        return html.unescape(re.sub(r"\s+", " ", h, flags=re.ASCII).strip(" "))

    def py_title(h):
        m = re.search(r"(?is)<title[^>]*>(.*?)</title>", h)
        t = m.group(1).strip(" ") if m else ""
        return html.unescape(t) if t else None

    rows = pages.collect()
    assert len(got) == len(rows) > 0
    for r in rows:
        assert got[r.page_id] == (py_title(r.html), py_text(r.html))


def test_scan_pairs_order_across_splits(spark, scratch):
    lines = [f"K{i % 50}=v{i}" for i in range(40000)]
    with open(f"{scratch}/big.env", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    last, first = {}, {}
    for ln in lines:
        k, v = ln.split("=", 1)
        last[k] = v
        first.setdefault(k, v)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert spark.read.text(f"{scratch}/big.env").rdd.getNumPartitions() > 1
        got_last = {r.key: r.value for r in fs.scan_pairs(spark, f"{scratch}/big.env").collect()}
        got_first = {r.key: r.value for r in fs.scan_pairs(spark, f"{scratch}/big.env", keep="first").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got_last == last and got_first == first


def test_stream_ingest_restart_and_merge(spark):
    from quarry.plans.catalog_streaming import WAVES, table_waves
    sink, ckpt = sj.run_folder(spark, "ingest-test")
    waves = table_waves(spark, SF_SMALL, "documents", "doc_id")
    for _ in range(2):
        docs = ix.map_fields(fx.doc_files_from(waves))
        sj.stream_ingest(docs, sink, ckpt, map_fn=lambda b: b).awaitTermination()
    assert _batches(spark, sink) >= WAVES
    cur = sj.read_current_index(spark, sink)
    assert cur.count() == fx.docs(spark, SF_SMALL).count()
    assert cur.select("id").distinct().count() == cur.count()


def test_stream_telemetry_keeps_late_and_untimed_records(spark, scratch):
    tel = fx.telemetry(spark, SF_SMALL)
    assert tel.where("Timestamp is null").count() > 0
    src = f"{scratch}/deliveries"
    ordered = tel.orderBy(F.col("Timestamp").desc())  # each file is older than the one before
    n = tel.count()
    for k in range(4):
        ordered.offset(k * n // 4).limit((k + 1) * n // 4 - k * n // 4).coalesce(1).write.mode("append").parquet(src)
    tel.coalesce(1).write.mode("append").parquet(src)     # all records re-sent
    stream = spark.readStream.schema(tel.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink, ckpt = sj.run_folder(spark, "telemetry-test")
    sj.stream_telemetry(stream, sink, ckpt).awaitTermination()
    out = sj.read_telemetry(spark, sink)
    assert out.exceptAll(tel).count() == 0 and tel.exceptAll(out).count() == 0


def test_global_rank_with_payload(spark):
    from quarry.plans.ordering import global_rank
    li = fx.table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    out = global_rank(li, [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], partitions=64)
    rows = out.orderBy("l_shipdate", "l_orderkey", "l_linenumber").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == li.count()


def test_postings_files_hold_near_disjoint_term_ranges(spark, scratch):
    from quarry.operators import search as se
    se.write_search_index(fx.docs(spark, SF_SMALL), f"{scratch}/idx", partitions=8)
    post = spark.read.parquet(f"{scratch}/idx/postings").where("field = 'content'")
    spans = (post.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min(F.struct("term", "id")).alias("lo"),
                                                                       F.max(F.struct("term", "id")).alias("hi"))
             .orderBy("lo").collect())
    assert len(spans) >= 4
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_persisted_index_equals_in_memory_search(spark, scratch):
    from quarry.operators import search as se
    docs = fx.docs(spark, SF_SMALL)
    se.write_search_index(docs, f"{scratch}/idx")
    texts = [r.content for r in docs.orderBy("id").limit(4).collect()]
    probes = [" ".join(t.split()[:6]) for t in texts] + ["the of and", "zzzz-unknown", "doc 7 pdf"]
    for q in probes:
        mem = [(r["rank"], r.id, r.score) for r in se.bm25_search(docs, q, 5).collect()]
        idx = [(r["rank"], r.id, r.score) for r in se.search_index(spark, f"{scratch}/idx", q, 5).collect()]
        assert sorted(mem) == sorted(idx), q
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(probes)], "query_id long, query string")
    batch = sorted(tuple(r) for r in se.retrieve_batch(queries, docs, 5).collect())
    stored = sorted(tuple(r) for r in se.retrieve_index(spark, f"{scratch}/idx", queries, 5).collect())
    assert batch == stored


def test_persisted_index_filtered_equals_in_memory(spark, scratch):
    from quarry.operators import search as se
    docs = fx.docs(spark, SF_SMALL)
    se.write_search_index(docs, f"{scratch}/idx")
    where = F.lower("file_name").like("%.pdf")
    q = "the of and doc pdf 42"
    mem = sorted(tuple(r) for r in se.filtered_search(docs, q, where, 10).collect())
    ids = docs.where(where).select("id")
    idx = sorted(tuple(r) for r in se.search_index(spark, f"{scratch}/idx", q, 10, where_ids=ids).collect())
    assert mem == idx and len(mem) > 0
