"""The approximate catalog scan: every column but the HyperLogLog++ distinct
count equals the exact profile, and the distinct count is within HLL error
of an exact count."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.operators.lookups import scope_filter
from quarry.plans.catalog_governance import PROFILE_SCHEMAS, _profile_inputs
from tests.conftest import SF_CHECK


def test_catalog_scan_approx_distinct_within_error(spark):
    approx = E.queries()["catalog_scan"](spark, SF_CHECK)
    exact = E.queries()["catalog_profile"](spark, SF_CHECK)
    same = approx.drop("distinct_approx")
    assert same.exceptAll(exact).count() == 0 and exact.exceptAll(same).count() == 0

    inputs = _profile_inputs(spark, SF_CHECK)
    orders = scope_filter(inputs["tables"]["orders"], inputs["scope"], inputs["workspaces"],
                          asset_ws_col="o_custkey")
    got = {(r["table"], r["column"]): r["distinct_approx"]
           for r in approx.select("table", "column", "distinct_approx").collect()}
    for t, cols in PROFILE_SCHEMAS.items():
        df = orders if t == "orders" else inputs["tables"][t]
        exact_counts = df.agg(*[F.count_distinct(c).alias(c) for c, _ in cols]).first().asDict()
        for c, _ in cols:
            n = exact_counts[c]
            assert abs(got[(t, c)] - n) <= max(2, 0.1 * n), (t, c, got[(t, c)], n)
