"""The prefix trie against a plain one, over many shards, and edge rows."""

import hashlib
import random
import re
import zlib

import __spark_entry__ as E
from quarry.llm import prefix_trie
from tests.conftest import SF_SMALL


def ordered(rows):
    """Turns of every conversation in order; ties by digest."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), d, role, text))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def plain(rows, rebuild=True):
    own = ordered(rows)
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        convs = {c: own.get(c - c % 20, [])[:h[c]] + t[h[c]:] for c, t in own.items()}
    else:
        convs = own
    members, ends = {}, {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^ \t-\r]+", p[-1][1])) if p else 0
        below = [total[k] for k in kids.get(p, ())]
        total[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, ())), *total[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()) for p, m in members.items())


def got(frame):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"],
                   r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in frame.collect())


def test_op13(spark, tables):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in tables("conversations")]
    assert got(E.queries()["op13_prefix_trie"](spark, SF_SMALL)) == plain(rows)


def test_many_shards(spark):
    rng = random.Random(3)
    rows = []
    for c in range(400):
        # copies of one conversation, long common beginnings, and a few of their own
        n = 30 if c % 3 == 0 else rng.randint(1, 24)
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t}" if c % 3 == 0 or t < 18 else f"turn {t} of {rng.randint(0, 2)}")
                 for t in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert got(prefix_trie.trie(prefix_trie.sequences(docs))) == plain(rows, rebuild=False)
        assert got(prefix_trie.trie(prefix_trie.rebuilt(docs))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_medians_and_tree():
    for n in (0, 1, 2, 7, 100):
        assert sorted(prefix_trie._medians(n)) == list(range(n))
    tree = prefix_trie._Tree()
    for k in prefix_trie._medians(1000):
        tree.insert([k, 1])
    deepest, level = 0, [(tree.down[0], 1)]
    while level:
        v, d = level.pop()
        if v >= 0:
            deepest = max(deepest, d)
            level += [(tree.low[v], d + 1), (tree.high[v], d + 1)]
    assert deepest == 10  # balanced: 2 ** 10 > 1000


def test_edge_rows(spark):
    long = "word " * 50_000
    rows = [(1, None, None, None), (1, 0, "user", "hi"), (2, 0, None, ""), (2, 0, None, ""), (None, 3, "user", "x"), (20, 1, "user", long),
            (21, 1, "user", long), (21, 2, "bot", None), (40, 5, "a", "bc"), (41, 5, "ab", "c"), (43, 1, "user", "é ü\x00z"), (7, 2, "x", "tie"),
            (7, 2, "y", "tie"), (-3, 0, "user", "hi")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, key string, depth int")
    assert got(prefix_trie.trie(prefix_trie.sequences(docs))) == plain(rows, rebuild=False)
    rebuilt = [r for r in rows if r[0] is None or r[0] >= 0]
    assert got(prefix_trie.trie(prefix_trie.rebuilt(docs.where("conv_id is null or conv_id >= 0")))) == plain(rebuilt)
    assert prefix_trie.trie(prefix_trie.rebuilt(docs.limit(0))).isEmpty()
