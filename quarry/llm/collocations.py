"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at sentence and line marks and into words at blanks
and tabs; per language every phrase of at most ``longest`` words inside a piece counts, overlaps
included.  A word is a 64-bit hash of its language and bytes.

1. Words are counted (numpy per chunk, then by Spark), then pairs of frequent words.
2. Suffixes that begin with two frequent pairs are cut at their first infrequent pair, equal ones
   are merged with their number, and all are routed by their leading words: a pair with more than
   2 ** ``SPLIT`` occurrences is dealt out by its third word as well, so no leading pair meets whole
   in one task.  Partitions hold about ``ROUTED`` suffixes each.
3. A task sorts its suffix pointers word by word: every segment is parted by a pivot into smaller,
   equal and larger ones, the equal part going one word deeper; the equal part's weight is the count
   of that prefix, and segments lighter than ``least`` are abandoned.  All segments of a level are
   parted at once by numpy.
4. Counts of the parts of every phrase are joined, the lowest-scoring cut is kept, and phrases that
   mostly stand inside a longer one are dropped; a longer phrase can only matter through those one
   word longer, as their counts are at least as large.

Which words and pairs are frequent is sent to the tasks as a table of 2 ** ``SLOT_BITS`` bytes (the
logarithm of the largest count that falls on a slot), whatever the vocabulary: an infrequent pair that
shares a slot passes and is abandoned later, so results are exact but for collisions of 64-bit hashes.

Defined results: null texts are empty, a null language is ``und``; ids do not matter, repeated rows
count again; ties of scores go by count, then by the phrase's bytes; an empty table or no frequent
phrase gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _text as X
from quarry.llm._io import written

SLOT_BITS = 22
SPLIT = 16
ROUTED = 1 << 20
CHUNK = 1 << 21
_BYTE = np.arange(256)
_MARK = np.isin(_BYTE, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_INSIDE = ~(_MARK | (_BYTE == 32) | (_BYTE == 9))
_SLOT = np.uint64((1 << SLOT_BITS) - 1)
_H = ["h1", "h2", "h3", "h4"]


def _chunks(batches):
    """(bytes, language per text, start, end, text of each word, hash of each word, whether the next word
    stands in the same piece) of every chunk."""
    for batch in batches:
        langs = pc.fill_null(batch.column(0), "und")
        raw, at = X.string_buffer(langs)
        key = X.mix(X.span_hash(raw, at[:-1], at[1:]) ^ X.MULT)  # not symmetric: a word may be a language's name
        for i, j, data, off in X.chunks(batch.column(1), CHUNK):
            low = X.LOWER[data]
            s, e, w_off = X.word_spans(low, off, _INSIDE)
            if not len(s):
                continue
            text = np.repeat(np.arange(j - i), np.diff(w_off))
            h = X.mix(X.span_hash(low, s, e) ^ key[i:j][text])
            h[h == 0] = 1  # 0 stands for no word
            marks = np.concatenate([[0], np.cumsum(_MARK[low])])
            follows = np.zeros(len(s), bool)
            follows[:-1] = (text[1:] == text[:-1]) & (marks[s[1:]] == marks[e[:-1]])
            yield low, langs.slice(i, j - i), s, e, text, h, follows


def _merged(columns: list[np.ndarray]):
    """(row of each distinct tuple, its number) of some columns of hashes."""
    with np.errstate(over="ignore"):
        one = np.zeros(len(columns[0]), np.uint64)
        for k, c in enumerate(columns):
            one += c * X.GRAM_KEY[k]
    _, first, n = np.unique(X.mix(one), return_index=True, return_counts=True)
    return first, n


def _pair_slot(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return X.mix(h1 * X.GRAM_KEY[8] + h2 * X.GRAM_KEY[9]) & _SLOT


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _words(batches):
    for low, langs, s, e, text, h, _ in _chunks(batches):
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        raw = low.tobytes()
        word = pa.array([raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(text[first])), word.cast(pa.string()), _long(h[first]),
                                          _long(n)], names=["lang", "word", "h", "n"])
        # all occurrences of the language, as a row without a word
        all_ = pc.value_counts(langs.take(pa.array(text)))
        none = pa.nulls(len(all_))
        yield pa.RecordBatch.from_arrays([all_.field("values"), none.cast(pa.string()), none.cast(pa.int64()),
                                          all_.field("counts")], names=["lang", "word", "h", "n"])


def _pairs(words):
    def run(batches):
        frequent = words.value
        for _, _, _, _, _, h, follows in _chunks(batches):
            ok = frequent[h & _SLOT] > 0
            at = np.flatnonzero(follows[:-1] & ok[:-1] & ok[1:])
            if len(at):
                first, n = _merged([h[at], h[at + 1]])
                a, b = h[at[first]], h[at[first] + 1]
                yield pa.RecordBatch.from_arrays([_long(a), _long(b), _long(_pair_slot(a, b)), _long(n)],
                                                 names=["h1", "h2", "slot", "n"])
    return run


def _suffixes(words, pairs, longest: int):
    def run(batches):
        frequent, paired = words.value, pairs.value
        for _, _, _, _, _, h, follows in _chunks(batches):
            near = np.flatnonzero(follows[:-1] & (frequent[h[:-1] & _SLOT] > 0) & (frequent[h[1:] & _SLOT] > 0))
            size = np.zeros(len(h) + longest, np.uint8)  # the logarithm of the pair's count, 0: infrequent
            size[near] = paired[_pair_slot(h[near], h[near + 1])]
            at = np.flatnonzero((size[:-1] > 0) & (size[1:] > 0))
            if not len(at):
                continue
            cols, going = [h[at], h[at + 1], h[at + 2]], np.ones(len(at), bool)
            wide = np.concatenate([h, np.zeros(longest, np.uint64)])
            for k in range(3, longest):
                going &= size[at + k - 1] > 0
                cols.append(np.where(going, wide[at + k], np.uint64(0)))
            first, n = _merged(cols)
            cols = [c[first] for c in cols] + [np.zeros(len(first), np.uint64)] * (4 - longest)
            parts = np.uint64(1) << np.maximum(size[at[first]].astype(np.int64) - SPLIT, 0).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*map(_long, cols), _long(cols[2] % parts), _long(n)], names=[*_H, "part", "n"])
    return run


def multikey_sort(keys: list[np.ndarray], weight: np.ndarray, least: int):
    """Three-way quicksort of pointers to suffixes, ``keys[d]`` being word d of every suffix (0: none).
    Returns (depth, pointer, weight): for every prefix of total weight ``least`` or more one suffix that
    begins with it."""
    if not len(weight):
        return (np.zeros(0, np.int64),) * 3
    order, table, found = np.arange(len(weight)), np.stack(keys), []
    start, size, depth = np.array([0]), np.array([len(weight)]), np.array([0])
    while len(start):
        first = np.concatenate([[0], np.cumsum(size)])
        seg = np.repeat(np.arange(len(size)), size)
        pos = np.arange(first[-1]) - first[:-1][seg] + start[seg]
        own = order[pos]
        key = table[depth[seg], own]
        three = np.sort(np.stack([key[first[:-1]], key[first[:-1] + size // 2], key[first[1:] - 1]]), axis=0)
        pivot = three[1]
        part = np.where(key < pivot[seg], 0, np.where(key == pivot[seg], 1, 2))
        cell = seg * 3 + part
        sizes = np.bincount(cell, minlength=3 * len(size))
        heavy = np.bincount(cell, weights=weight[own], minlength=3 * len(size)).astype(np.int64)
        # stable counting partition: the place of a row is its part's begin plus its rank in the part
        begin = (np.cumsum(sizes) - sizes).reshape(-1, 3) - first[:-1, None] + start[:, None]
        rank = np.empty(len(seg), np.int64)
        for k in range(3):
            inside = part == k
            run = np.cumsum(inside)
            base = np.concatenate([[0], run])[first[:-1]]
            rank[inside] = (run - 1 - base[seg])[inside]
        order[begin.ravel()[cell] + rank] = own
        begin = begin.ravel()
        deeper = np.tile([0, 1, 0], len(size))
        level = np.repeat(depth, 3) + deeper
        worth = (sizes > 0) & (heavy >= least) & ((deeper == 0) | (np.repeat(pivot, 3) != 0))
        hit = np.flatnonzero(worth & (deeper == 1))
        found.append((level[hit], order[begin[hit]], heavy[hit]))
        go = np.flatnonzero(worth & (level < len(keys)))
        start, size, depth = begin[go], sizes[go], level[go]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counted(least: int):
    def run(batches):
        cols = [[] for _ in range(5)]
        for batch in batches:
            for k in range(5):
                cols[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        keys = [np.concatenate(c).view(np.uint64) for c in cols[:4]]
        depth, row, n = multikey_sort(keys, np.concatenate(cols[4]), least)
        long = np.flatnonzero(depth >= 3)
        depth, row, n = depth[long], row[long], n[long]
        out = [np.where(depth > k, keys[k][row], np.uint64(0)) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*map(_long, out), _long(n)], names=[*_H, "n"])
    return run


def _slots(rows: DataFrame, slot: str) -> np.ndarray:
    """1 + log2 of the largest count on each slot, 0 where none is frequent: at most 2 ** SLOT_BITS rows
    of five bytes reach the driver."""
    top = rows.groupBy(F.col(slot).cast("int").alias("s")).agg(F.floor(F.log2(F.max("n"))).cast("tinyint").alias("c"))
    found = top.toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[found["s"].to_numpy()] = found["c"].to_numpy() + 1
    return table


def count_phrases(docs: DataFrame, lang_col: str, text_col: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, word, h, n) of the frequent words, with a row without a word for each
    language's total, and (h1, ..., h4, n) of the frequent phrases of two words or more."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = (texts.mapInArrow(_words, "lang string, word string, h long, n long")
             .groupBy("lang", "word", "h").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull()))
    words = written(words, "phrase-words")
    frequent = spark.sparkContext.broadcast(_slots(
        words.where("word is not null").select(F.col("h").bitwiseAND(F.lit(int(_SLOT))).alias("slot"), "n"), "slot"))
    pairs = (texts.mapInArrow(_pairs(frequent), "h1 long, h2 long, slot long, n long")
             .groupBy("h1", "h2", "slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    pairs = written(pairs, "phrase-pairs")
    none = F.lit(0).cast("long")
    two = pairs.select("h1", "h2", none.alias("h3"), none.alias("h4"), "n")
    if longest < 3:
        return words, two
    paired = spark.sparkContext.broadcast(_slots(pairs, "slot"))
    suffixes = (texts.mapInArrow(_suffixes(frequent, paired, longest), ", ".join(f"{h} long" for h in _H) + ", part long, n long")
                .groupBy(*_H, "part").agg(F.sum("n").alias("n")))
    suffixes = written(suffixes, "phrase-suffixes")
    frequent.unpersist()
    paired.unpersist()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // ROUTED))
    more = (suffixes.repartition(tasks, "h1", "h2", "part").select(*_H, "n")
            .mapInArrow(_counted(least), ", ".join(f"{h} long" for h in _H) + ", n long"))
    return words, written(two.unionByName(more), "phrase-counts")


def _part(cols: list, name: str):
    """A phrase of some of the words, in the form of the keys."""
    none = F.lit(0).cast("long")
    return [c.alias(f"{name}{k + 1}") for k, c in enumerate([*cols, *[none] * (4 - len(cols))])]


def _cuts(phrases: DataFrame) -> DataFrame:
    """Every phrase (h1, ..., h4, a) with each of its cuts: k, first part (l1, ...) and rest (r1, ...)."""
    h = [F.col(x) for x in _H]
    every = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(k).alias("k"), *_part(h[:k], "l"), *_part(h[k:n], "r"))
                      for n in (2, 3, 4) for k in range(1, n)])
    return (phrases.select(*_H, F.col("n").alias("a"), _size().alias("words"), F.explode(every).alias("c"))
            .select(*_H, "a", "words", "c.*").where("size = words").drop("size", "words"))


def _inner(phrases: DataFrame) -> DataFrame:
    """(h1, ..., h4, n): both parts of every phrase that are one word shorter."""
    h = [F.col(x) for x in _H]
    every = F.array(*[F.struct(F.lit(n).alias("size"), *_part(h[k:k + n - 1], "p")) for n in (3, 4) for k in (0, 1)])
    return (phrases.select("n", _size().alias("words"), F.explode(every).alias("c")).select("n", "words", "c.*")
            .where("size = words").select(*[F.col(f"p{k + 1}").alias(x) for k, x in enumerate(_H)], "n"))


def _size():
    return F.expr("2 + if(h3 != 0, 1, 0) + if(h4 != 0, 1, 0)")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, top: int = 2000,
         share: int = 80) -> DataFrame:
    """The ``top`` collocations of every language: (lang, rank, phrase, a, l, r, n, score).

    ``a``, ``l``, ``r``: occurrences of the phrase and of both parts of its lowest-scoring cut; ``n``: all
    words of the language; ``share``: percentage of a phrase's occurrences inside one longer phrase from
    which it is dropped; ``longest``: 2 to 4 words."""
    words, phrases = count_phrases(docs, lang_col, text_col, least, longest)
    none = F.lit(0).cast("long")
    single = words.where("word is not null").select(F.col("h").alias("h1"), none.alias("h2"), none.alias("h3"),
                                                    none.alias("h4"), "n")
    counts = single.unionByName(phrases)
    cut = _cuts(phrases)
    for side in ("l", "r"):
        keyed = counts.select(*[F.col(h).alias(f"{side}{k + 1}") for k, h in enumerate(_H)], F.col("n").alias(side))
        cut = cut.join(keyed, [f"{side}{k}" for k in range(1, 5)])
    # exact: products of decimals, whole-number division
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = cut.groupBy(*_H, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    longer = _inner(phrases).groupBy(*_H).agg(F.max("n").alias("inside"))
    kept = (best.join(longer, _H, "left")
            .where(F.col("inside").isNull() | F.expr(f"100 * cast(inside as decimal(20, 0)) < {share} * cast(a as decimal(20, 0))"))
            .select(*_H, "a", "b.score", "b.l", "b.r"))
    named = words.where("word is not null").select("lang", "word", "h")
    kept = kept.join(named.select("lang", F.col("word").alias("w1"), F.col("h").alias("h1")), "h1")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    kept = kept.withColumn("tied", F.rank().over(w)).where(F.col("tied") <= top)  # ties stay until the phrase is known
    for k in (2, 3, 4):
        kept = kept.join(named.select(F.col("word").alias(f"w{k}"), F.col("h").alias(f"h{k}")), f"h{k}", "left")
    phrase = F.concat_ws(" ", *[f"w{k}" for k in range(1, 5)])
    total = words.where("word is null").select("lang", "n")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
            .join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
