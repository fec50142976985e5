"""Blocks of vectors are compared where they are read, and give brute force's links, components and counts."""

import io
from contextlib import redirect_stdout

import numpy as np

from quarry.llm import embeddings
from quarry.llm._io import prepare


def test_pairs_of_blocks_are_not_moved(spark, monkeypatch):
    prepare(spark)
    pairs, plans = embeddings.block_pairs, []

    def seen(*args):
        buf, out = io.StringIO(), pairs(*args)
        with redirect_stdout(buf):
            out.explain()
        plans.append(buf.getvalue())
        return out
    monkeypatch.setattr(embeddings, "block_pairs", seen)
    x = np.random.default_rng(4).normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(rows, block=16).count() == 300
    assert len(plans) == 1 and "CartesianProduct" in plans[0] and "Exchange" not in plans[0]


def test_many_blocks_and_cells_equal_brute_force(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(embeddings, "EDGES", 8)  # stars are made again and again
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.2, 0.4, 0.6)] + [base[:9]] * 3)
    short = rng.normal(size=(30, 2))
    vectors = [*x, *short]
    ids = [None if i % 11 == 5 else i for i in range(len(vectors))]
    for kind, dtype in (("float", np.float32), ("double", np.float64)):
        rows = spark.createDataFrame([(i, np.asarray(v, dtype).astype(float).tolist()) for i, v in zip(ids, vectors, strict=True)],
                                     f"vec_id long, embedding array<{kind}>").repartition(5)
        out = {r["vec_id"]: r for r in embeddings.near_duplicates(rows, block=8, max_pivots=12).collect() if r["vec_id"] is not None}
        u = [np.asarray(v, dtype).astype(float) for v in vectors]
        u = [v / np.linalg.norm(v) for v in u]
        near = np.array([[len(a) == len(b) and a @ b >= 0.9 for b in u] for a in u])
        named = np.array([i is not None for i in ids])
        label = np.arange(len(u))
        while True:  # along vectors that have an id
            new = np.array([label[near[i] & named].min() if named[i] else i for i in range(len(u))])
            if (new == label).all():
                break
            label = new
        # all copies of a vector count, those without an id too
        assert {i: (r["n_links"], r["component_id"]) for i, r in out.items()} == {
            i: (int(near[i].sum()) - 1, int(label[i])) for i in out}
        assert len(out) == named.sum()


def test_vectors_without_id_neither_join_nor_part_others(spark):
    prepare(spark)
    turned = [[float(np.cos(t)), float(np.sin(t))] for t in (0.0, 0.4, -0.4, 0.1)]  # 1 and 2 meet only by way of 0
    for order in ((0, 1, 2), (1, 0, 2), (2, 1, 0)):
        rows = spark.createDataFrame([((None, 1, 2)[k], turned[k]) for k in order] + [(3, [5.0]), (4, [6.0])],
                                     "vec_id long, embedding array<double>").coalesce(1)
        out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(rows).collect()}
        assert out[1] == (1, 1) and out[2] == (1, 2) and out[3] == (1, 3) and out[4] == (1, 3)
    rows = spark.createDataFrame([(None, turned[0]), (1, turned[1]), (2, turned[3]), (3, turned[0])], "vec_id long, embedding array<double>")
    out = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(rows).collect()}
    assert out[1] == out[2] == out[3] == 1
