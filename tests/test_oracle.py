"""Every registered query with an oracle matches its DuckDB twin (rows,
column names, Arrow types, order-insensitive values); the rest run."""

import pytest

import __spark_entry__ as E
from quarry.plans import registry
from tests.conftest import SF_CHECK
from tests.oracle import compare

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    rec = compare(spark, SF_CHECK, [name], verbose=False)[name]
    assert "error" not in rec, rec.get("error")
    if rec["oracle"]:
        assert rec["rows_ok"] and rec["cols_ok"] and rec["kinds_ok"] and rec["hash_ok"], rec
    else:
        assert rec["rows"] >= 0


def test_every_query_but_non_sql_has_oracle():
    no_oracle = set(registry.queries()) - set(E.oracle_sql())
    assert no_oracle <= {"catalog_scan", "extract_text"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 5
    assert df.columns == ["rank", "id", "score"]


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_pairwise_join(spark, name):
    """No registered query pairs rows without an equi key."""
    import io
    from contextlib import redirect_stdout

    from tests.conftest import SF_SMALL
    df = E.queries()[name](spark, SF_SMALL)
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
