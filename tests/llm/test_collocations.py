"""Collocations: the sort against counting, the whole miner against a plain version, edge rows."""

import re
from collections import Counter

import numpy as np

import __spark_entry__ as E
from quarry.llm import collocations
from tests.conftest import SF_SMALL

UPPER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=30, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = [b for (g, q), b in cand.items() if g == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], total[lang]))
    return {(lang, rank + 1, p.decode(), -a, left, right, n, -s) for lang, rows in out.items()
            for rank, (s, a, p, left, right, n) in enumerate(sorted(rows)[:top])}


def got(frame):
    return {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect()}


def test_multikey_sort_counts_prefixes():
    rng = np.random.default_rng(4)
    for spread, least in ((3, 1), (3, 30), (40, 5), (1, 2)):
        keys = [rng.integers(1, spread + 1, 3000).astype(np.uint64) for _ in range(4)]
        short = rng.integers(1, 5, 3000)
        keys = [np.where(short > k, x, np.uint64(0)) for k, x in enumerate(keys)]
        weight = rng.integers(1, 4, 3000)
        want = Counter()
        for i in range(3000):
            for d in range(1, short[i] + 1):
                want[tuple(int(k[i]) for k in keys[:d])] += int(weight[i])
        depth, row, n = collocations.multikey_sort(keys, weight, least)
        found = {tuple(int(k[r]) for k in keys[:d]): int(c) for d, r, c in zip(depth, row, n, strict=True)}
        assert len(found) == len(depth) and found == {p: c for p, c in want.items() if c >= least}
    assert len(collocations.multikey_sort([np.zeros(0, np.uint64)] * 4, np.zeros(0, np.int64), 1)[0]) == 0


def test_op12(spark, tables):
    want = plain([(r["lang"], r["text"]) for r in tables("documents")])
    assert len(want) > 20 and got(E.queries()["op12_collocations"](spark, SF_SMALL)) == want


def test_split_pairs_and_small_limits(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(6)] + ["hot", "pair"]
    rows = [("en" if i % 3 else None, " ".join(rng.choice(words, 60)).replace("hot", "Hot PAIR") + (", " if i % 2 else "\n"))
            for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = plain(rows, least=3, top=40)
    assert got(collocations.mine(docs, least=3, top=40)) == want
    monkeypatch.setattr(collocations, "SPLIT", 2)  # every pair is dealt out by its third word
    monkeypatch.setattr(collocations, "ROUTED", 50)
    assert got(collocations.mine(docs, least=3, top=40)) == want


def test_edge_rows(spark, messy):
    rows = [(r["lang"], r["text"]) for r in messy.collect()]
    assert got(collocations.mine(messy)) == plain(rows)
    assert collocations.mine(messy.limit(0)).isEmpty()
    assert collocations.mine(messy.where("doc_id = 2")).isEmpty()
    same = [("en", "new york city")] * 40 + [("en", "new york\ncity")] * 5
    assert got(collocations.mine(spark.createDataFrame(same, "lang string, text string"))) == plain(same)
