"""The texts of contexts move once to be chosen and once to their index."""

import re

from quarry.llm import suffixes
from tests.conftest import SF_SMALL


def test_texts_of_contexts_move_twice_at_most(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to send
    try:
        found = suffixes.repeated(docs)
        found._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    execution = found._jdf.queryExecution()
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*bytes#", plan)
    assert 1 <= len(moved) <= 2
