"""Source mixing: quotas against quotients dealt one by one, targets, pieces, and edge rows."""

import heapq

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm._io import written


def dealt(weights, caps, seats):
    quota = [0] * len(weights)
    heap = [(-w, i) for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    heapq.heapify(heap)
    while heap and seats:
        _, i = heapq.heappop(heap)
        quota[i] += 1
        seats -= 1
        if quota[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * quota[i] + 1), i))
    return quota


@pytest.mark.parametrize("weights, seats", [
    ([10.0, 10.0, 10.0, 1.0], 5), ([1000.4, *[0.4] * 50], 1020), ([3.0, 1.0, 2.0] * 7, 40), ([5.0], 3), ([0.0, 2.0], 9),
    ([1.0, 1e6], 700), ([2.0, 2.0], 0)])
def test_quotas_are_those_of_the_highest_quotients(spark, weights, seats):
    caps = [1 + (i * 7) % 900 + int(w) for i, w in enumerate(weights)]
    parties = written(spark.createDataFrame(list(zip(range(len(weights)), weights, caps, strict=True)), "i int, w double, c long"), "parties")
    got = {r["i"]: r["quota"] for r in mixing.apportion(parties, seats, "w", "c", [F.asc("i")]).collect()}
    assert [got[i] for i in range(len(weights))] == dealt(weights, caps, seats)


def test_targets_stop_at_twice_the_source(spark):
    rows = [("a", 10, 1, 1), ("b", 1000, 1, 2), ("c", 100, 1, 3), ("d", 0, 1, 4), (None, 5, 1, 5)]
    sources = written(spark.createDataFrame(rows, "source string, source_size long, rows long, place long"), "sources")
    got = {r["source"]: r["target"] for r in mixing.targets(sources, (3, 1, 2), 1.5, 2).collect()}
    total = 1115 * 1.5
    assert got["a"] == 20 and got["d"] == 0 and got[None] == 10 and got["c"] == 200
    assert got["b"] == pytest.approx(total - 230) and sum(got.values()) == pytest.approx(total)


def test_mix(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(i % 97)), ["hot", "hot", "b", None][i % 4]) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, shard_words=512, block=4).cache()
    rows = mixed.collect()
    assert len(rows) == 400 and {r["doc_id"]: r["size"] for r in rows} == {i: len(t.split()) for i, t, _ in texts}
    for source in ("hot", "b", None):
        mine = [r for r in rows if r["source"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.02 * mine[0]["target"] + 8
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    # a shard's blocks are a little shorter than four words where these do not divide its words
    assert abs(sum(r["taken"] for r in rows) / (1.5 * sum(r["size"] for r in rows)) - 1) <= 0.005
    again = mixing.mix(docs.repartition(7, "text"), shard_words=512, block=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    # the texts of the mix are the words that its pieces name
    words = {}
    for r in mixing.texts(docs, mixed).collect():
        got = r["text"].split()
        assert got == texts[r["doc_id"]][1].split()[r["start"]:r["end"]]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(got)
    assert words == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}


def test_edge_rows(spark, messy):
    rows = mixing.mix(messy).collect()
    assert len(rows) == 13
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0}
    assert sum(r["taken"] for r in rows) > 0
    assert mixing.mix(messy.limit(0)).isEmpty()
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string"))
    assert [(r["taken"], r["target"]) for r in blank.collect()] == [(0, 0.0)] * 2
    # equal rows take their own parts; together they come to the target
    same = spark.createDataFrame([(1, "a b c d e f g h", "x")] * 3000 + [(2, "i j", "y")], "doc_id long, text string, source string")
    got = mixing.mix(same, shard_words=64, block=4).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 3000, 2: 1}
    assert abs(next(r["t"] for r in got if r["doc_id"] == 1) - (1.5 * 24002 - 4)) <= 8
