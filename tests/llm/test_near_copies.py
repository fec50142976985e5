"""Texts that share words are not near copies; texts with almost the same words are."""

import numpy as np

from quarry.llm.toxicity import near_copies, telling_words


def test_only_similar_word_sets_are_grouped():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(1, 2**63, 400, dtype=np.uint64))
    texts = [np.unique(rng.choice(pool, 60, replace=False)) for _ in range(300)]  # each holds the smallest words often
    texts[7] = np.unique(np.append(texts[3][:-1], np.uint64(5)))  # a near copy
    texts[9] = texts[3]
    group = near_copies(texts + [np.zeros(0, np.uint64)] * 2)
    assert group[7] == group[9] == group[3] and group[300] == group[301]
    assert len(np.unique(group)) == 300 - 2 + 1


def test_every_distinct_toxic_text_counts():
    """Ten toxic texts that all hold the smallest hash of their language are ten witnesses."""
    rng = np.random.default_rng(6)
    common, told = np.uint64(1), np.uint64(2**62)
    sets, toxic = [], []
    for i in range(100):
        own = rng.integers(2**61, 2**62, 30, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([[common], own, [told] if i < 10 else []]).astype(np.uint64)))
        toxic.append(int(i < 10))
    size = [len(u) for u in sets]
    _, group = np.unique(near_copies(sets), return_inverse=True)
    found = telling_words(np.concatenate(sets), np.repeat(group, size), np.repeat(toxic, size))
    assert told in found and common not in found
