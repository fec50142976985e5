"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits.  Seeds are runs of ``seed`` words that a
document shares with a test item, joined by hash.  For each (document, item) with a seed the
longest non-overlapping matches of at least ``seed`` words are marked again and again with
running Karp-Rabin (hash windows of the current length, verified word by word, halving the
length while nothing is found), each word of either side being used once.  An item leaks into
a document if the tiles cover at least ``coverage`` of the item's words, in whatever order they
stand in the document, so rearranged passages count.

The test items are the stated query set: they are sent to the tasks in blocks of at most
``block_seeds`` seeds (a fixed bound), each block against all documents in one pass without a
shuffle.  Items shorter than ``seed`` words match as a whole run of their words.

Defined results: null or empty documents and items match nothing; null ids are ordinary values;
repeated documents are judged alike; repeated items count once each; among equally long tiles
the first in the document, then in the item, is marked; an empty table on either side gives no
leaks; other columns pass through ``clean`` and ``scan`` keeps only the id.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm import _text as X


def _hashed(text: str) -> np.ndarray:
    data = X.lower_bytes(np.frombuffer(text.encode("utf-8"), dtype=np.uint8))
    s, e, _ = X.word_spans(data, np.array([0, len(data)]))
    return X.span_hash(data, s, e)


def _windows(words: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows of ``length`` words that hold no marked word."""
    if len(words) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    used = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(used[length:] == used[:-length])
    with np.errstate(over="ignore"):
        power = X._powers(X.MULT, len(words) + 1)
        pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)], dtype=np.uint64)])
        inverse = X._powers(X.MULT_INV, len(words) + 1)
        return (pre[start + length] - pre[start]) * inverse[start], start


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in doc, start in item, words)."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = min(len(doc), len(item))
    while length >= least:
        found: list[tuple[int, int, int]] = []
        hd, sd = _windows(doc, free_d, length)
        hi, si = _windows(item, free_i, length)
        if len(hd) and len(hi):
            where = defaultdict(list)
            for h, s in zip(hi.tolist(), si.tolist(), strict=True):
                where[h].append(s)
            for at in np.flatnonzero(np.isin(hd, hi)):
                d = int(sd[at])
                for i in where[int(hd[at])]:
                    if not np.array_equal(doc[d:d + length], item[i:i + length]):
                        continue
                    # a match may go on to the right: the longest ones are marked first
                    n, end = length, min(len(doc) - d, len(item) - i)
                    while n < end and free_d[d + n] and free_i[i + n] and doc[d + n] == item[i + n]:
                        n += 1
                    found.append((n, d, i))
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        again = False
        for n, d, i in found:
            if free_d[d:d + n].all() and free_i[i:i + n].all():
                free_d[d:d + n] = free_i[i:i + n] = False
                out.append((d, i, n))
            else:
                again = True  # what is left of it may still be a tile of this length
        if not found or not again:
            length = length - 1 if length <= 2 * least else max(least, length // 2)
    return out


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, coverage: float = 0.6,
         block_seeds: int = 2_000_000) -> DataFrame:
    """(id, item_id, covered, words, tiles) for every document and item that leaks into it;
    ``tiles`` lists (doc_word, item_word, words).  Items are read in blocks as the query set."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = (f"`{id_col}` {kind}, `{item_col}` {item_kind}, covered long, words long, "
              "tiles array<struct<doc_word:long,item_word:long,words:long>>")
    out = None
    for block in _query_blocks(items, item_col, item_text_col, block_seeds):
        part = (docs.select(F.col(id_col), F.col(text_col).cast("string"))
                .mapInArrow(_matcher(spark.sparkContext.broadcast(block), to_arrow_type(items.schema[item_col].dataType),
                                     seed, coverage, id_col, item_col), schema))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _query_blocks(items: DataFrame, item_col: str, text_col: str, block_seeds: int):
    """The test items in order, streamed to the driver a partition at a time and cut into
    blocks of at most ``block_seeds`` words."""
    block, size = [], 0
    for r in (items.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t"))
              .where("t is not null").toLocalIterator()):
        words = _hashed(r["t"])
        if not len(words):
            continue
        if block and size + len(words) > block_seeds:
            yield block
            block, size = [], 0
        block.append((r["i"], words))
        size += len(words)
    if block:
        yield block


def _matcher(items, item_kind: pa.DataType, seed: int, coverage: float, id_col: str, item_col: str):
    kind = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        block = items.value
        seeds = {}  # words of a seed -> (sorted hashes, items that hold them)
        for k in sorted({min(seed, len(w)) for _, w in block}):
            held = [(h, j) for j, (_, w) in enumerate(block) if min(seed, len(w)) == k
                    for h in X.gram_hash(w, k).tolist()]
            held.sort()
            seeds[k] = (np.array([h for h, _ in held], np.uint64), np.array([j for _, j in held]))
        for batch in batches:
            ids, found = [], []
            for i, _, data, off in X.chunks(batch.column(1)):
                low = X.lower_bytes(data)
                s, e, w_off = X.word_spans(low, off)
                words = X.span_hash(low, s, e)
                doc = np.repeat(np.arange(len(w_off) - 1), np.diff(w_off))
                pairs = set()
                for k, (hashes, holders) in seeds.items():
                    grams = X.gram_hash(words, k)
                    if not len(grams):
                        continue
                    inside = doc[k - 1:] == doc[:len(grams)]
                    left = np.searchsorted(hashes, grams)
                    hit = np.flatnonzero(inside & (hashes[np.minimum(left, len(hashes) - 1)] == grams))
                    right = np.searchsorted(hashes, grams[hit], side="right")
                    for at, lo, hi in zip(doc[hit].tolist(), left[hit].tolist(), right.tolist(), strict=True):
                        pairs.update((at, j) for j in holders[lo:hi].tolist())
                for at, j in sorted(pairs):
                    item = block[j][1]
                    got = tiles(words[w_off[at]:w_off[at + 1]], item, min(seed, len(item)))
                    covered = sum(n for _, _, n in got)
                    if covered >= coverage * len(item):
                        ids.append(i + at)
                        found.append((block[j][0], covered, len(item), sorted(got)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array([f[0] for f in found], item_kind),
                 pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                 pa.array([[{"doc_word": d, "item_word": i, "words": n} for d, i, n in f[3]] for f in found], kind)],
                names=[id_col, item_col, "covered", "words", "tiles"])
    return run


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that an item leaks into (rows with a null id stay)."""
    hit = scan(docs, items, id_col, **options).select(id_col).distinct()
    return docs.join(hit, id_col, "left_anti")
