"""Each query against a plain version of its contract on a small fixture, or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import __spark_entry__ as E
from quarry.llm import suffixes
from quarry.llm.packing import _Words
from tests.conftest import SF_SMALL
from tests.llm.test_paragraph_cut import plain as plain_paragraphs


def run(spark, name, sf=SF_SMALL):
    return E.queries()[name](spark, sf).toPandas()


def smallest_reachable(ids, neighbours):
    label = np.arange(len(ids))
    while True:
        new = np.array([label[j].min() for j in neighbours])
        if np.array_equal(new, label):
            return np.asarray(ids)[label]
        label = new


def test_op1(spark, tables):
    rows = sorted(tables("embeddings"), key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    out = run(spark, "op1_embedding_dedup").sort_values("vec_id")
    assert out.n_links.tolist() == (near.sum(1) - 1).tolist()
    assert out.component_id.tolist() == smallest_reachable([r["vec_id"] for r in rows], [np.flatnonzero(n) for n in near]).tolist()
    assert (out.kept == (out.vec_id == out.component_id)).all()


def test_op1_tiles_lose_no_pair_near_the_threshold():
    from quarry.llm.embeddings import linked, unit
    rng = np.random.default_rng(3)
    a = unit(rng.normal(size=(300, 48)))
    b = unit(a + rng.normal(size=a.shape) * 0.07)  # cosines around 0.9
    want = np.nonzero(np.einsum("id,jd->ij", a, b) >= 0.9)
    assert len(want[0]) > 50
    assert set(zip(*linked(a, b, 0.9), strict=True)) == set(zip(*want, strict=True))


def test_op2(spark, tables):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in tables("documents")}
    count = Counter(hash(b[p:p + 400]) for b in texts.values() for p in range(len(b) - 399))
    for r in run(spark, "op2_suffix_dedup").itertuples():
        b = texts[r.doc_id]
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if count[hash(b[p:p + 400])] > 1:
                gone[p:p + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op2_matching_statistics_are_exact():
    rng = np.random.default_rng(5)
    for trial in range(20):
        base = rng.integers(97, 99 + trial % 3, 40).astype(np.uint8)
        regions = [np.concatenate([base[a:b], rng.integers(97, 100, 5).astype(np.uint8), base[:a]])
                   for a, b in (sorted(rng.integers(0, 41, 2)) for _ in range(4))]
        index = suffixes.RunLengthIndex(regions)
        got, raw = index.matching_statistics(), [bytes(r) for r in regions]
        every = [(r, p) for r, b in enumerate(raw) for p in range(len(b))]

        def common(x, y):
            n = 0
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
            return n
        for r, p in every:
            best = max(common(raw[r][p:], raw[s][q:]) for s, q in every if (s, q) != (r, p))
            assert got[index.start[r] + p] == best


def test_op2_hot_anchors_take_the_counted_path(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    common, long = word(390), word(450)
    data = [(i, word(300) + common + word(300)) for i in range(12)]
    data += [(100 + i, word(200) + long + word(200)) for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for hot in (2, 1000):
        out = {r["doc_id"]: r["n_removed"] for r in suffixes.clean(docs, hot=hot).collect()}
        assert all(out[i] == 0 for i in range(12)) and all(out[100 + i] == 450 for i in range(3))


@pytest.mark.parametrize("name,label,modulus,rest", [("op3_quality_classifier", "quality", 5, 0), ("op9_toxicity", "toxic", 4, 2)])
def test_classifiers_on_the_held_out_fold(spark, tables, name, label, modulus, rest):
    sf = "/root/testdata/sf0.1"
    out = run(spark, name, sf).set_index("doc_id")
    fold = {i: zlib.crc32(str(i).encode()) % modulus == rest for i in out.index}
    assert out.held_out.to_dict() == fold
    assert (out.predicted == (out.score >= 0.3)).all() and out.score.between(0, 1).all()
    truth = {r["doc_id"]: r[label] for r in tables("labels", sf) if fold.get(r["doc_id"])}
    hits = Counter((y, int(out.predicted[i])) for i, y in truth.items())
    assert hits[1, 1] >= 0.9 * (hits[1, 1] + hits[1, 0]) and hits[0, 0] >= 0.95 * (hits[0, 0] + hits[0, 1])


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_op4(spark, tables):
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in v.split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15)
    texts = {r["doc_id"]: r["text"] or "" for r in tables("documents")}
    for r in run(spark, "op4_pii").itertuples():
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, texts[r.doc_id]) if good(k, m[0])] for k, p in base.items()}
        flat = [s for k in base for s in spans[k]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(spans[k]) for k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert set(flat) <= set(r.spans.split(",")) | {""}


def test_op4_weak_supervision_adds_spelled_out_data(spark):
    from quarry.llm import pii
    data = [(i, f"call me on phone +1 (2{i:02d}) 555-01{i:02d} today") for i in range(40)]
    data += [(100 + i, f"my phone (3{i:02d}) 555-02{i:02d} works") for i in range(15)]
    out = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(len(out[i]) == 1 and out[i][0]["base"] for i in range(40))
    assert all(s["probability"] >= 0.5 for i in range(15) for s in out[100 + i])


def test_op5(spark, tables):
    texts = sorted((r["doc_id"], r["text"] or "") for r in tables("documents"))
    found, where, root = [], {}, []
    for i, t in texts:
        for w in plain_paragraphs(t):
            if len(w) >= 20:
                found.append((i, frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4))))
    root = list(range(len(found)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (_, s) in enumerate(found):
        for b, n in Counter(b for g in s for b in where.get(g, ())).items():
            if n >= 0.8 * (len(s) + len(found[b][1]) - n):
                p, q = sorted((top(a), top(b)))
                root[q] = p
        for g in s:
            where.setdefault(g, []).append(a)
    removed = Counter(i for a, (i, _) in enumerate(found) if top(a) != a)
    out = run(spark, "op5_paragraph_dedup").set_index("doc_id")
    assert out.n_paragraphs.sum() == len(found)
    assert all(out.n_removed[i] == removed[i] for i, _ in texts)


def test_op6(spark, tables):
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r["item_id"]: plain(r["text"]) for r in tables("benchmark")}
    out = run(spark, "op6_decontamination").set_index("doc_id")
    for r in tables("documents"):
        t = plain(r["text"] or "")
        whole = {i for i, v in items.items() if v and v in t}
        assert whole <= set(out["items"][r["doc_id"]])
        assert bool(out.contaminated[r["doc_id"]]) == bool(len(out["items"][r["doc_id"]]))


def test_op7(spark, tables):
    out = run(spark, "op7_secret_scan").set_index("doc_id")
    for r in tables("documents"):
        want = ",".join(f"{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"] or ""))
        assert out.spans[r["doc_id"]] == want


def test_op8(spark, tables):
    rows = sorted((r["doc_id"], r["text"] or "") for r in tables("documents"))
    prints = []
    for _, t in rows:
        w = t.encode().lower().split()
        grams = [b" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    bits = np.array(prints, dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(x ^ bits) <= 3) for x in bits]
    out = run(spark, "op8_simhash").sort_values("doc_id")
    assert out.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert out.component_id.tolist() == smallest_reachable([i for i, _ in rows], near).tolist()


def test_op8_links_within_a_dense_bucket(spark):
    from quarry.llm import simhash
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 6)
    prints = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 48, (400, 2))})
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp long, id long")
    got = simhash.components(simhash.links(nodes, 3))
    label = {r["node"]: r["component"] for r in got.collect()}
    bits = np.array(prints, dtype=np.int64).view(np.uint64)
    want = smallest_reachable(range(len(prints)), [np.flatnonzero(np.bitwise_count(x ^ bits) <= 3) for x in bits])
    assert [label.get(k, k) for k in range(len(prints))] == want.tolist()


def test_op10(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out = run(spark, "op10_packing")
    texts = {r["doc_id"]: r["text"] or "" for r in tables("documents")}
    assert set(out.doc_id) == set(texts)
    for i, x in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
        assert x.start.tolist() == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() == len(ids) == x.doc_tokens.iloc[0]
        assert x.ids_crc32.tolist() == [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(x.start, x.length)]
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        size = x.length.sum()
        assert x.offset.tolist() == [0, *np.cumsum(x.length)[:-1]] and size <= 2048 and size & (size - 1) == 0
    window = out.groupby(["window_id", "source"]).length.sum().unstack(fill_value=0)
    assert (window.max() - window.min()).max() <= 1  # every window has every source's quantum


def test_op10_tokens_of_odd_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["it's a 'test' don't!'s \"'re", "Ünïcode — “quotes” … naïve İstanbul ΣΑΣ ẞ", "x<|endoftext|>y z", "éà H̱ Å",
             "日本語 テキスト 12,345.67 ½ ²", "a\x1cb\x85c d e　f", "", "   ", "×÷À¿ Ã©", "don't’s ’s'll x'LL I'M",
             "tab\tnl\n\x0b\x0c\r end", "a​b ﻿c", None]
    ids, n = _Words(path).texts(pa.array(texts), 1)
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing_targets(spark):
    import public_tokenizers

    from quarry.llm import packing
    docs = spark.createDataFrame([(i, "one two three four", "a" if i % 4 else "b") for i in range(800)],
                                 "doc_id long, text string, source string")
    out = packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), max_tokens=64, window=4,
                       targets={"a": 1.0, "b": 1.0}).toPandas()
    assert out.length.sum() == 800 * 5
    first = out[out.window_id < 5].groupby(["window_id", "source"]).length.sum().unstack()
    assert ((first.a - first.b).abs() <= 1).all()


def test_pipeline_rows(spark, tables):
    """Every stage keeps what the operators' brute-force checks say: here their composition."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_SMALL)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = spark.createDataFrame(after.collect(), after.schema)
    left = {r["doc_id"] for r in docs.collect()}
    packed = E.queries()["pipeline"](spark, SF_SMALL).toPandas()
    assert set(packed.doc_id) == left
    texts = " ".join(r["text"] or "" for r in docs.collect())
    assert not re.search(r'(?i)token = "[0-9a-f]{40}"', texts)
