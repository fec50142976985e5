"""Hot keys: one key holds a third of all rows.  Results must stay whole and
exact (checked against pandas), and the plans must reduce the hot key before
the shuffle (partial aggregate / partial group limit)."""

import io
from contextlib import redirect_stdout

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import lake as lk
from quarry.operators import lookups as lkp
from quarry.operators import runs as rn
from quarry.plans import fixtures as fx
from tests.conftest import SF_CHECK


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def _skewed_runs(spark):
    r = fx.runs(spark, SF_CHECK)
    # a third of all runs belong to indexer 0
    return r.withColumn("indexer", F.when(F.col("run_id") % 3 == 0, F.lit(0).cast("bigint"))
                        .otherwise(F.col("indexer")))


def test_run_report_hot_indexer(spark):
    runs = _skewed_runs(spark)
    rep = rn.run_report(runs)
    plan = _plan(rep)
    assert "partial_max_by" in plan and "partial_sum" in plan
    got = {r.indexer: (r.runs, r.total_processed, r.last_status) for r in rep.collect()}
    pdf = runs.toPandas().sort_values(["start", "run_id"])
    want = {}
    for k, g in pdf.groupby("indexer"):
        want[k] = (len(g), int(g["itemsProcessed"].sum()), g.iloc[-1]["status"])
    assert got == want
    assert got[0][0] >= len(pdf) // 3


def test_last_n_runs_hot_indexer(spark):
    runs = _skewed_runs(spark)
    last = rn.last_n_runs(runs, 3)
    assert "WindowGroupLimit" in _plan(last) and "Partial" in _plan(last)
    got = sorted((r.indexer, r.run_id) for r in last.collect())
    pdf = runs.toPandas().sort_values(["start", "run_id"], ascending=False)
    want = sorted((k, rid) for k, g in pdf.groupby("indexer") for rid in g["run_id"].head(3))
    assert got == want


def test_silver_hot_duplicate_group(spark):
    d = fx.docs(spark, SF_CHECK)
    # a third of the documents carry the same content
    hot = d.withColumn("content", F.when(F.abs(F.hash("id")) % 3 == 0, F.lit("same text"))
                       .otherwise(F.col("content")))
    silver = lk.silver_documents(hot)
    assert "partial_min(" in _plan(silver)  # winners by id alone: no aggregate holds the text
    pdf = hot.select("id", "content").toPandas()
    want = pdf.groupby("content")["id"].agg(["min", "count"])
    got = {r.content: (r.id, r.copies) for r in silver.select("content", "id", "copies").collect()}
    assert got == {c: (row["min"], row["count"]) for c, row in want.iterrows()}


def test_resolve_hot_name(spark):
    o = fx.table(spark, SF_CHECK, "orders")
    names = o.select(F.when(F.col("o_orderkey") % 3 == 0, F.lit("ORDER-1"))
                     .otherwise(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("name"))
    li = fx.table(spark, SF_CHECK, "lineitem").select("l_orderkey").distinct()
    listing = li.select(F.concat(F.lit("item-"), F.col("l_orderkey").cast("string")).alias("id"),
                        F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("displayName"))
    res = lkp.resolve_by_name(names, listing)
    got = res.groupBy("resolved").count().collect()
    total = sum(r["count"] for r in got)
    assert total == names.count()           # every name kept, hot or not
    keys = set(listing.select(F.lower("displayName")).toPandas().iloc[:, 0])
    nm = names.toPandas()["name"].str.lower()
    want_resolved = int(nm.isin(keys).sum())
    assert {r.resolved: r["count"] for r in got}.get(True, 0) == want_resolved


def test_latest_state_hot_run(spark):
    ev = fx.status_events(spark, SF_CHECK)
    hot = ev.withColumn("run_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("bigint"))
                        .otherwise(F.col("run_id")))
    ls = rn.latest_state(hot)
    assert "partial_max_by" in _plan(ls)
    pdf = hot.toPandas()
    pdf["st"] = pdf["status"].fillna(pdf["runStatus"])
    pdf = pdf.sort_values(["ts", "event_id"])
    want = {k: g.iloc[-1]["st"] for k, g in pdf.groupby("run_id")}
    got = {r.run_id: r.state for r in ls.collect()}
    assert got == want
    assert isinstance(pd.Timestamp(ls.where("run_id = -1").first().first_ts), pd.Timestamp)

