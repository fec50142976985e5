"""Contexts of anchors hold each window once, and the index sorts only suffixes that share a rank."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import suffixes


def test_a_window_is_in_the_context_of_one_anchor(spark):
    rng = np.random.default_rng(11)
    data = [(i, "".join(rng.choice(list("abcdefgh"), n))) for i, n in enumerate((399, 400, 401, 2500, 9000))]
    texts = suffixes._texts(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text")
    size = {r["d"]: len(r["text"]) for r in texts.collect()}
    held = defaultdict(Counter)
    for r in suffixes.occurrences(texts, 400, 200).collect():
        held[r["d"]].update(range(r["lo"], r["lo"] + suffixes._size(400, r["shape"]) - 399))
    for d, n in size.items():
        assert held[d] == Counter(range(n - 399))


def test_suffixes_that_differ_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.integers(97, 123, 50_000).astype(np.uint8)
    regions, sort, sorted_ = [base, base[1000:2000]], np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda x, *a, **b: sorted_.append(len(x)) or sort(x, *a, **b))
    index = suffixes.RunLengthIndex(regions)
    monkeypatch.undo()
    assert sum(sorted_) < 1.5 * sum(len(r) + 1 for r in regions)
    match = index.matching_statistics()
    assert match[1000] == 1000 == match[index.start[1]] and match[1500] == 500


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_periodic_and_nested_repeats_equal_brute_force(spark, hot):
    rng, length = np.random.default_rng(13), 12
    word = lambda n, kinds: "".join(rng.choice(list("abcdef"[:kinds]), n))
    parts = [word(20, 4), word(13, 2), "ab" * 15, "c" * 14, word(30, 6), word(11, 6)]
    texts = ["".join(parts[i] if i < len(parts) else word(int(rng.integers(0, 25)), 6) for i in rng.integers(0, 9, rng.integers(0, 6)))
             for _ in range(120)] + ["a" * 40, "ab" * 20, parts[4], parts[4]]
    count = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in suffixes.clean(docs, length=length, anchor=6, hot=hot).collect():
        t, gone = texts[r["doc_id"]], np.zeros(len(texts[r["doc_id"]]), bool)
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p:p + length] = True
        assert bytes(r["kept"]).decode() == "".join(x for x, g in zip(t, gone, strict=True) if not g)
