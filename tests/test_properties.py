"""Property tests (hypothesis) on small generated inputs, checked against
plain-Python brute force."""

import base64
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.functions import names as nm
from quarry.operators import index as ix

SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def py_slug(s):
    if not s:
        return None
    x = re.sub("-+", "-", re.sub("[^a-z0-9-]", "-", s.lower())).strip("-")
    if not x:
        return None
    if len(x) > 128:
        x = x[:128].strip("-")
    return x or None


@SETTINGS
@given(st.lists(st.text(alphabet="aZ9-_ !é.", max_size=300), min_size=1, max_size=8))
def test_safe_name_equals_python_and_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(nm.safe_name("x")).collect()]
    assert got == [py_slug(v) for v in values]
    again = [r[0] for r in spark.createDataFrame([(g,) for g in got], "x string")
             .select(nm.safe_name("x")).collect()]
    assert again == got


@SETTINGS
@given(st.lists(st.text(min_size=0, max_size=200), min_size=1, max_size=6))
def test_key_decodes_to_path(spark, paths):
    df = spark.createDataFrame([(p,) for p in paths], "x string")
    rows = df.select(nm.document_key("x").alias("k"), nm.decode_key(nm.document_key("x")).alias("d")).collect()
    for p, r in zip(paths, rows):
        assert r.k == base64.urlsafe_b64encode(p.encode()).decode().rstrip("=")
        assert r.d == p


@SETTINGS
@given(st.lists(st.text(alphabet="abc ", max_size=5000), min_size=1, max_size=4),
       st.integers(min_value=50, max_value=400), st.integers(min_value=0, max_value=49))
def test_chunks_rejoin(spark, texts, size, overlap):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    got = {}
    for r in ix.chunk_text(df, size=size, overlap=overlap).collect():
        got.setdefault(r.id, {})[r.chunk_no] = r.chunk
    for i, t in enumerate(texts):
        parts = [got[str(i)][k] for k in sorted(got[str(i)])]
        rebuilt = parts[0] + "".join(p[overlap:] for p in parts[1:])
        assert rebuilt == t
        assert all(len(p) <= size for p in parts)


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 10 ** 6)),
                min_size=1, max_size=300, unique_by=lambda t: t[1]),
       st.integers(min_value=1, max_value=7))
def test_global_rank_equals_sorted_position(spark, rows, parts):
    from pyspark.sql import functions as F

    from quarry.plans.ordering import global_rank
    df = spark.createDataFrame(rows, "value int, id long")
    ranked = global_rank(df, [F.col("value").asc_nulls_first(), F.col("id").asc()], partitions=parts)
    got = {r.id: r["rank"] for r in ranked.collect()}
    order = sorted(rows, key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1]))
    assert got == {ident: i + 1 for i, (_, ident) in enumerate(order)}
