"""More sources than the driver lists: every source stays a queue of its own."""

import public_tokenizers
import pytest

from quarry.llm import packing


@pytest.mark.parametrize("targets", [None, {"s1": 0.9, "s2": 0.4, "missing": 1.0}])
def test_pieces_are_those_of_few_sources(spark, targets):
    data = [(i, "one two three four five " * (1 + i % 7), f"s{i % 11}" if i % 11 else None) for i in range(700)]
    data += [(1000 + i, "", f"t{i}") for i in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").coalesce(3)
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    few, many = (packing.pack(docs, path, max_tokens=64, window=4, targets=targets, max_queues=n, with_ids=True).toPandas()
                 for n in (4096, 3))
    for out in (few, many):
        assert out.groupby("doc_id").length.sum().to_dict() == out.groupby("doc_id").doc_tokens.first().to_dict()
        for _, x in out.sort_values("offset").groupby("sequence_id"):
            ends = (x.offset + x.length).tolist()
            assert x.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 64
    if targets is None:
        order = ["doc_id", "start"]
        assert few.sort_values(order).values.tolist() == many.sort_values(order).values.tolist()
    else:
        first = many[many.window_id < 5].groupby(["window_id", "source"]).length.sum().unstack()
        assert ((first.s1 / first.s2 - 0.9 / 0.4).abs() < 0.1).all()
