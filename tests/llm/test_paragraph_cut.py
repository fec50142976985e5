"""Paragraphs are cut at sentence ends, short lines are joined, lone short ones stay, and passages shared
between documents are found."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.llm import _text as X
from quarry.llm import paragraphs


def plain(text, least=20):
    """The words of every paragraph of a text."""
    out, pending = [], []
    for line in text.split("\n"):
        parts = [re.findall(r"[^\W_]+", p.lower()) for p in re.split(r"(?<=[.!?])(?=[ \t\r\x0b\x0c])", line)]
        words = [w for p in parts for w in p]
        if not words or len(words) >= least:
            out += [pending] if pending else []
            pending = []
        if len(words) >= least:
            now, left = [], len(words)
            for p in parts:
                now, left = now + p, left - len(p)
                if p and len(now) >= least and left >= least:
                    out.append(now)
                    now = []
            out.append(now)
        elif words:
            pending = pending + words
            if len(pending) >= least:
                out.append(pending)
                pending = []
    return out + ([pending] if pending else [])


def cut(texts):
    data, off = X.string_buffer(pa.array(texts))
    low = X.lower_bytes(data)
    ws, we, w_off = X.word_spans(low, off)
    got = [[] for _ in texts]
    for f, e, a, b in zip(*paragraphs._cut(data, off, ws, we, w_off, 20), strict=True):
        doc = int(np.searchsorted(w_off, f, "right") - 1)
        got[doc].append((re.findall(r"[^\W_]+", bytes(low[ws[f]:we[e - 1]]).decode()), int(a - off[doc]), int(b - off[doc])))
    return got


def test_cut_is_that_of_the_plain_version(tables):
    texts = [r["text"] or "" for r in tables("documents")] + [
        "", "one", "a b.\nc d", "x " * 19 + "\n\n" + "y " * 19, ("Word word word. " * 30).strip(), "a. " * 45, "no end " * 50, "---\n" + "q " * 25 + "\n***\nz",
        "Really? yes! " * 9 + "\n" + "short line\n" * 14 + "\n" + "tail"]
    for text, got in zip(texts, cut(texts), strict=True):
        assert [w for w, _, _ in got] == plain(text)
        raw = text.encode()
        for k, (w, a, b) in enumerate(got):
            assert re.findall(r"[^\W_]+", raw[a:b].decode().lower()) == w and (k + 1 == len(got) or b <= got[k + 1][1])


def test_what_is_removed(spark):
    wide = " ".join(f"word{i}" for i in range(30))
    short = "A stock line of seven short words"
    wrapped = "\n".join(" ".join(f"wrap{i}x{j}" for j in range(9)) for i in range(3))
    said = f"{wide.replace('word', 'said')}."
    docs = spark.createDataFrame([
        (1, f"{short}\n\n{wide}\n\n{wrapped}"), (2, f"{short}\n\n{wide.upper()}\nend"), (3, f"start\n\n{wrapped}\n\nother"),
        (4, f"{said} {wide.replace('word', 'more')}. Done."), (5, f"{wide.replace('word', 'own')}. {said} {wide.replace('word', 'fin')}!")],
        "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs).collect()}
    assert left[1] == docs.first()["text"]
    assert left[2] == f"{short}\n\nend"  # the stock line stays
    assert left[3] == "start\n\n\nother"
    assert left[5] == f"{wide.replace('word', 'own')}. {wide.replace('word', 'fin')}!"
    counts = {(r["doc_id"], r["words"]): r["size"] for r in paragraphs.duplicates(docs).where("words = 7").collect()}
    assert counts == {(1, 7): 2, (2, 7): 2}


def shared_runs(docs, length=51):
    """Documents that hold a run of words that stands in one of a smaller id, too."""
    ids, hashes = [], []
    for i, text in docs:
        data = X.lower_bytes(np.frombuffer((text or "").encode(), np.uint8))
        s, e, _ = X.word_spans(data, np.array([0, len(data)]))
        w = X.span_hash(data, s, e)
        if len(w) >= length:
            with np.errstate(over="ignore"):
                power = X._powers(X.MULT, len(w) + 1)
                pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:len(w)], dtype=np.uint64)])
                run = (pre[length:] - pre[:-length]) * X._powers(X.MULT_INV, len(w) + 1)[:len(w) - length + 1]
            run = np.unique(run)
            hashes.append(run)
            ids.append(np.full(len(run), i))
    hashes, ids = np.concatenate(hashes), np.concatenate(ids)
    order = np.lexsort((ids, hashes))
    again = np.flatnonzero(hashes[order][1:] == hashes[order][:-1]) + 1
    return set(ids[order][again].tolist())


def test_shared_passages_are_caught_and_others_left_alone(spark):
    sf = "/root/testdata/sf0.1"
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    docs = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    shared = shared_runs(docs)
    out = paragraphs.duplicates(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).where("removed")
    touched = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    caught = len(shared & touched) / len(shared)
    spared = 1 - len(touched - shared) / (len(docs) - len(shared))
    print("caught", caught, "spared", spared)
    assert len(shared) > 1000 and caught >= 0.93 and spared >= 0.93
