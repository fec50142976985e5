"""Value semantics and edge rows (FIXTURES §3) on tiny in-memory frames."""

import base64
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import names as nm
from quarry.functions.formats import DATASOURCE_KIND, OWN_DATASOURCE_PREFIX
from quarry.functions import text as tx
from quarry.functions import values as vl
from quarry.operators import index as ix
from quarry.operators import lookups as lk
from quarry.operators import reconcile as rc
from quarry.operators import search as se
from quarry.sources import files as fs


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("!!!", None), ("", None), (None, None), ("My Workspace_01", "my-workspace-01"),
    ("--a--b--", "a-b"), ("Ünïcode Név", "n-code-n-v"),
])
def test_safe_name(spark, raw, want):
    assert one(spark, nm.safe_name("x"), raw) == want


def test_safe_name_cut_at_128_then_trimmed(spark):
    raw = "a" * 127 + "-" + "b" * 5
    got = one(spark, nm.safe_name("x"), raw)
    assert got == "a" * 127 and len(got) == 127


def test_document_key_long_path_has_no_line_break(spark):
    path = "https://example.com/" + "segment/" * 30 + "file.pdf"
    got = one(spark, nm.document_key("x"), path)
    want = base64.urlsafe_b64encode(path.encode()).decode().rstrip("=")
    assert got == want and "\n" not in got
    back = one(spark, nm.decode_key("x"), got)
    assert back == path


def test_present_and_first_present(spark):
    df = spark.createDataFrame([(None, "", "null", "<x>", "v")], "a string, b string, c string, d string, e string")
    assert df.select(vl.first_present("a", "b", "c", "d", "e")).first()[0] == "v"
    assert df.select(vl.first_present("a", "b", "c", "d")).first()[0] is None


def test_age_days_counts_whole_24h_periods(spark):
    now = dt.datetime(2024, 2, 1, 0, 0, 0)
    rows = [(now - dt.timedelta(days=7),), (now - dt.timedelta(days=7) + dt.timedelta(minutes=1),), (None,)]
    df = spark.createDataFrame(rows, "c timestamp_ntz")
    nowc = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    got = df.select(vl.age_days("c", nowc).alias("a"), vl.old_enough("c", nowc, 7).alias("o")).collect()
    assert [(r.a, r.o) for r in got] == [(7, True), (6, False), (None, True)]


def test_case_insensitive_exclusion(spark):
    ws = spark.createDataFrame([("Alpha",), ("BETA",), ("gamma",)], "displayName string")
    ex = spark.createDataFrame([("alpha",), ("beta",)], "name string")
    assert [r[0] for r in lk.exclude_named(ws, ex).collect()] == ["gamma"]
    assert len(lk.exclude_named(ws, ex, case_sensitive=True).collect()) == 3


@pytest.mark.parametrize("n,chunks", [(0, 1), (200, 1), (2000, 1), (2001, 2), (3800, 2), (3801, 3)])
def test_chunk_edges(spark, n, chunks):
    text = "".join(chr(97 + i % 26) for i in range(n))
    df = spark.createDataFrame([("k", text)], "id string, content string")
    got = ix.chunk_text(df).orderBy("chunk_no").collect()
    assert len(got) == chunks
    # chunks re-join to the source text
    rebuilt = "".join(r.chunk if i == 0 else r.chunk[200:] for i, r in enumerate(got))
    assert rebuilt == text


def test_pairs_rules(spark):
    lines = spark.createDataFrame(
        [(0, "A="), (1, "=x"), (2, "A=b=c"), (3, 'Q="quoted"'), (4, ""), (5, "A=last")],
        "line_no int, line string")
    last = {r.key: r.value for r in fs.parse_pairs(lines, "last").collect()}
    first = {r.key: r.value for r in fs.parse_pairs(lines, "first").collect()}
    assert last == {"A": "last", "Q": "quoted"} or last == {"A": "last", "Q": "quoted", "": "x"}
    assert first["A"] == "" and first["Q"] == "quoted"


def test_classify_order(spark):
    df = spark.createDataFrame([(201, ""), (None, "x UnsupportedCapacitySKU"), (409, ""),
                                (None, "ItemDisplayNameAlreadyInUse"), (None, "notinactivestate"),
                                (503, ""), (429, ""), (400, "bad")], "code int, body string")
    got = [r[0] for r in df.select(vl.classify_outcome("code", "body")).collect()]
    assert got == ["created", "unsupported", "present", "present", "retry", "retry", "retry", "failed"]


def test_redaction_case_insensitive(spark):
    got = one(spark, vl.redact_tokens("x"), "auth: bearer abc.DEF-ghi_~+/== rest")
    assert got == "auth: Bearer [REDACTED] rest"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id string, content string, title string, file_name string")


def test_search_edges(spark):
    d = _docs(spark, [("a", "alpha beta beta", "t", "a.pdf"), ("b", "gamma", "t", "b.pdf"),
                      ("c", "beta", "x", "c.pdf")])
    assert se.bm25_search(d, "", 5).count() == 0
    assert se.bm25_search(d, "zzz", 5).count() == 0
    once = [(r.id, r.score) for r in se.bm25_search(d, "beta", 5).collect()]
    twice = [(r.id, r.score) for r in se.bm25_search(d, "beta BETA beta", 5).collect()]
    # the one-token document wins on length normalisation
    assert once == twice and [i for i, _ in once] == ["c", "a"]
    assert [r.id for r in se.bm25_search(d, "gamma", 5).collect()] == ["b"]


def test_postings_tf_sums_to_token_count(spark):
    d = _docs(spark, [("a", "x y x z, x!", "T x", "a.pdf"), ("b", "", None, "b.pdf")])
    p = ix.build_postings(d)
    tot = {(r.field, r.id): r.s for r in p.groupBy("field", "id").agg(F.sum("tf").alias("s")).collect()}
    assert tot[("content", "a")] == 5 and tot[("title", "a")] == 2 and tot[("file_name", "a")] == 2
    dl = {(r.field, r.id): r.dl for r in p.select("field", "id", "dl").distinct().collect()}
    assert dl[("content", "a")] == 5


def test_bm25_matches_formula(spark):
    import math
    d = _docs(spark, [("a", "x x y", "", "a.txt"), ("b", "y", "", "b.txt")])
    got = {r.id: r.score for r in se.bm25_search(d, "x", 5, fields=["content"]).collect()}
    n, df_, tf, dl, avg = 2, 1, 2, 3, 2.0
    idf = math.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
    want = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert got == {"a": round(want, 6)}


def test_priority_no_candidate_and_ties(spark):
    req = spark.createDataFrame([(1,), (2,)], "workspace_id long")
    empty = spark.createDataFrame([], "name string, kind string, collection string")
    got = {r.request: (r.datasource, r.choice) for r in lk.pick_by_priority(req, empty, "acct").collect()}
    own = OWN_DATASOURCE_PREFIX
    assert got == {1: (f"{own}1", "create"), 2: (f"{own}2", "create")}
    kind = DATASOURCE_KIND
    c = spark.createDataFrame([("zz", kind, "child"), ("bb", kind, "acct"), ("aa", kind, None),
                               (f"{own}2", "Other", None)], "name string, kind string, collection string")
    got = {r.request: (r.datasource, r.choice) for r in lk.pick_by_priority(req, c, "acct").collect()}
    assert got == {1: ("aa", "root"), 2: (f"{own}2", "own")}


def test_reconcile_second_run_is_empty(spark):
    desired = spark.createDataFrame([("a",), ("B",)], "name string")
    existing = spark.createDataFrame([("A", 1)], "name string, id long")
    plan = rc.reconcile(desired, existing)
    created = plan.where("action = 'create'").select("name", F.lit(2).cast("long").alias("id"))
    again = rc.reconcile(desired, existing.unionByName(created))
    assert again.where("action = 'create'").count() == 0


def test_merge_principals_prefers_existing(spark):
    cur = spark.createDataFrame([("s", 1, "User")], "scope string, id long, principalType string")
    add = spark.createDataFrame([("s", 1, "Group"), ("s", 2, "Group")], "scope string, id long, principalType string")
    got = {r.id: (r.principalType, r.origin) for r in rc.merge_principals(cur, add).collect()}
    assert got == {1: ("User", "current"), 2: ("Group", "added")}


def test_tokens_python_equivalence(spark):
    import regex
    text = "L'été 2024: Größe, naïve façade — X-ray 3D"
    got = one(spark, tx.tokens("x"), text)
    assert got == regex.findall(r"[\p{L}\p{N}]+", text.lower())


def test_field_stats_from_terms_equal_direct(spark):
    d = _docs(spark, [("a", "x y x", None, "a.pdf"), ("b", "", "T", "b.pdf"), ("c", "!!!", "t t", None)])
    direct = {r.field: (r.n_docs, r.avg_dl) for r in ix.field_stats(d).collect()}
    derived = {r.field: (r.n_docs, r.avg_dl) for r in ix.field_stats_from_terms(ix.term_counts(ix.build_postings(d)), d).collect()}
    assert derived == direct
