"""Greedy string tiling against a plain version: tiles, items and coverage, reordered and rearranged passages."""

import re

import numpy as np

import __spark_entry__ as E
from quarry.llm import decontaminate
from tests.conftest import SF_SMALL


def plain_tiles(doc, item, least):
    """Again and again the longest common run of unmarked words, the first in the document, then in the item."""
    doc, item, out = list(doc), list(item), []
    while True:
        where = {}
        for j, w in enumerate(item):
            if w is not None:
                where.setdefault(w, []).append(j)
        best, ending = (least - 1, 0, 0), {}
        for i, w in enumerate(doc):
            now = {}
            for j in where.get(w, ()) if w is not None else ():
                n = now[j] = ending.get(j - 1, 0) + 1
                key = (n, -(i - n + 1), -(j - n + 1))
                if n >= least and (best[0] < least or key > (best[0], -best[1], -best[2])):
                    best = (n, i - n + 1, j - n + 1)
            ending = now
        n, i, j = best
        if n < least:
            return sorted(out)
        out.append((i, j, n))
        doc[i:i + n] = [None] * n
        item[j:j + n] = [None] * n


def test_tiles_of_rearranged_passages():
    rng = np.random.default_rng(8)
    for trial in range(60):
        words = rng.integers(1, 4 + trial % 40, 40).astype(np.uint64)
        cuts = sorted(rng.integers(0, 41, 3))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
        rng.shuffle(parts)
        doc = np.concatenate([x for p in parts for x in (rng.integers(1, 60, 3).astype(np.uint64), p)])
        got, want = decontaminate.tiles(doc, words, 5), plain_tiles(doc.tolist(), words.tolist(), 5)
        assert all((doc[d:d + n] == words[i:i + n]).all() and n >= 5 for d, i, n in got)
        if trial % 40 >= 16:  # words that repeat little: no two runs compete
            assert sorted(got) == want


def test_op6_items_and_coverage(spark, tables):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in tables("benchmark")}
    grams = {}
    for k, w in items.items():
        for i in range(max(1, len(w) - 4)):
            grams.setdefault(tuple(w[i:i + 5]), set()).add(k)
    out = E.queries()["op6_decontamination"](spark, SF_SMALL).toPandas().set_index("doc_id")
    leaks = 0
    for r in tables("documents"):
        d = words(r["text"])
        near = set().union(*(grams.get(tuple(d[i:i + 5]), ()) for i in range(max(1, len(d) - 4))))
        found = {}
        for k in near:
            covered = sum(n for _, _, n in plain_tiles(d, items[k], 5))
            if covered >= 0.6 * len(items[k]):
                found[k] = covered / len(items[k])
        assert out["items"][r["doc_id"]].tolist() == sorted(found)
        assert out.coverage[r["doc_id"]] == max(found.values(), default=0.0)
        leaks += len(found)
    assert leaks >= 3
