"""The quality model is fitted on all labelled rows and all their pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import quality


def test_model_is_that_of_all_rows_and_pairs(spark, tables):
    n = 21_000  # more than a sample of 20,000 held
    r = F.xxhash64("doc_id")
    odd = F.when(F.pmod(r, F.lit(7)) == 0, F.concat(F.lit("!! ## "), F.repeat(F.lit("spam "), F.pmod(r, F.lit(5)).cast("int"))))
    docs = spark.range(n).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.concat(F.coalesce(odd, F.lit("Some plain words. ")), F.repeat(F.lit("word and "), F.pmod(r, F.lit(11)).cast("int")),
                           F.md5(F.col("doc_id").cast("string"))).alias("text"))
    labels = docs.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) == 0, 1 - (F.pmod(r, F.lit(7)) != 0).cast("int"))
                         .otherwise((F.pmod(r, F.lit(7)) != 0).cast("int")).alias("quality"))
    model = quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").collect()
    x, y = quality.features(pa.array([r["text"] for r in rows])), np.array([r["quality"] for r in rows])
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1.0, x.std(0))
    s = z @ model["w"]
    a, b, grad = z[y == 1], z[y == 0], np.zeros(z.shape[1])
    for i in range(0, len(a), 500):
        q = 1 / (1 + np.exp(s[y == 1][i:i + 500, None] - s[y == 0]))
        grad += q.sum(1) @ a[i:i + 500] - q.sum(0) @ b
    assert np.abs(grad / (len(a) * len(b)) - 1e-3 * model["w"]).max() < 1e-3
    k = int(round((y == 0).mean() * n))
    assert abs(model["cut"] - np.sort(s)[k - 1:k + 1].mean()) < 1e-6


def test_order_statistics(spark):
    values = [3.0] * 40 + [-7.5, 1e6, 2.0, 2.0, 5.0 + 1e-12, 5.0]
    table, want = spark.createDataFrame([(v,) for v in values], "s double"), sorted(values)
    for k in (1, 2, 3, 4, 43, 44, 45):
        assert quality._around(table, k) == (want[k - 1], want[k])
    assert quality._around(table, len(want)) == (1e6, 1e6)
