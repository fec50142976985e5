"""Substring dedup by paragraph MinHash banding.

Paragraphs are cut by the text alone, in bytes: a line of at least ``min_words`` words (lower-cased
runs of letters and digits) is cut at its sentence ends into pieces of at least that many words, what
would be shorter staying with the piece before it; consecutive shorter lines are joined until they
have that many words or a line without words follows.  What stays shorter is reported (``size`` counts
equal ones) but never removed.
Bands of MinHash values over word shingles are tuned for a recall (``tune``).  Equal
paragraphs are merged by a 64-bit hash of their words; of each group that shares a band the
member of smallest hash is paired with the others, the pairs of all bands are made distinct and
verified by exact Jaccard on shingle sets.  Groups whose members are not all connected then are
cut into blocks of ``BLOCK``, and pairs of blocks are compared member by member, skipping those
already connected; so no group meets in one task and no group's pairs are written out.
Components cluster the paragraphs, and all but the first occurrence (id, then place) of each
cluster are removed.

Defined results: null or empty texts and those of fewer than ``shingle`` words have no paragraphs; rows that
repeat an id are one document; paragraphs of null ids come first; ties between occurrences go by id and
place; an empty table gives an empty result; other columns pass through ``remove``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as X
from quarry.llm._graph import components
from quarry.llm._io import written

BLOCK = 128
KEY_BITS = 27
_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_rng = np.random.default_rng(11)
_FACTOR = _rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _rng.integers(0, 2**63, 512, dtype=np.uint64)


def tune(threshold: float, recall: float = 0.999, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the fewest bands of three rows or more that find a pair at the threshold with this
    probability; shorter rows where that takes more than ``most`` MinHash values."""
    for rows in (3, 2, 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def _shingled(data: np.ndarray, off: np.ndarray, k: int):
    """(shingle hashes, offsets per text, word hashes, word offsets) of some texts."""
    low = X.lower_bytes(data)
    s, e, w_off = X.word_spans(low, off)
    words = X.span_hash(low, s, e)
    n = np.diff(w_off)
    grams = X.gram_hash(words, k)
    text = np.repeat(np.arange(len(n)), n)
    inside = text[k - 1:] == text[:len(grams)] if len(grams) else np.zeros(0, bool)
    return grams[inside], np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))]), words, w_off


def _signatures(grams: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per text (with at least one shingle) and band."""
    out = np.zeros((len(off) - 1, bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            for r in range(rows):
                j = b * rows + r
                least = np.minimum.reduceat((grams ^ _OFFSET[j]) * _FACTOR[j], off[:-1])
                out[:, b] += least * _FACTOR[-1 - j]
    return X.mix(out)


def _cut(data: np.ndarray, off: np.ndarray, ws: np.ndarray, we: np.ndarray, w_off: np.ndarray, min_words: int):
    """(first word, end word, start, end) of the paragraphs of some texts, offsets in their buffer."""
    stop = np.flatnonzero(data == 10)
    mark = _END[data]
    mark[:-1] &= X.SPACE[data[1:]] | np.isin(np.arange(1, len(data)), off)
    mark = np.flatnonzero(mark)
    last = np.zeros(len(ws), bool)
    last[w_off[1:][w_off[1:] > w_off[:-1]] - 1] = True
    after = np.append(ws[1:], len(data))  # where the next word begins
    lines = np.searchsorted(stop, after) - np.searchsorted(stop, we)
    line_end = last | (lines > 0)
    closes = (last | (lines > 1)).tolist()
    sentence = np.flatnonzero(~line_end & (np.searchsorted(mark, after) > np.searchsorted(mark, we))) + 1
    ends = np.flatnonzero(line_end) + 1
    begins = np.concatenate([[0], ends[:-1]])
    lo, hi = np.searchsorted(sentence, begins, "right").tolist(), np.searchsorted(sentence, ends).tolist()
    sentence, first, end, pending = sentence.tolist(), [], [], -1
    for a, b, i, j in zip(begins.tolist(), ends.tolist(), lo, hi, strict=True):
        if b - a < min_words:
            pending = a if pending < 0 else pending
            if b - pending >= min_words or closes[b - 1]:
                first.append(pending)
                end.append(b)
                pending = -1
            continue
        if pending >= 0:
            first.append(pending)
            end.append(a)
            pending = -1
        for c in sentence[i:j] if b - a >= 2 * min_words else ():
            if c - a >= min_words and b - c >= min_words:
                first.append(a)
                end.append(c)
                a = c
        first.append(a)
        end.append(b)
    first, end = np.array(first, np.int64), np.array(end, np.int64)
    # whole lines from their first to their last byte, pieces from one sentence mark to the next
    text = np.searchsorted(off, ws[first], "right") - 1
    line_from = np.maximum(np.append(stop, 0)[np.searchsorted(stop, ws[first]) - 1] + 1, off[text])
    line_from = np.where(np.searchsorted(stop, ws[first]) == 0, off[text], line_from)
    line_to = np.minimum(np.append(stop, len(data))[np.searchsorted(stop, we[end - 1])], off[text + 1])
    before, at = np.concatenate([[True], line_end])[first], np.append(mark, 0)
    start = np.where(before, line_from, at[np.searchsorted(mark, ws[first]) - 1] + 1)
    stop_at = np.where(line_end[end - 1], line_to, at[np.searchsorted(mark, after[end - 1]) - 1] + 1)
    return first, end, start, stop_at


def find(docs: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """(doc, place, start, end, words, h, bands, text) of every paragraph; offsets in bytes.
    Those of fewer than ``min_words`` words have no bands and no text."""
    def run(batches):
        for batch in batches:
            for i, _, data, off in X.chunks(batch.column(1)):
                low = X.lower_bytes(data)
                ws, we, w_off = X.word_spans(low, off)
                if not len(ws):
                    continue
                first, last, s, e = _cut(data, off, ws, we, w_off, min_words)
                n = last - first
                doc = np.searchsorted(w_off, first, "right") - 1
                place = np.arange(len(first)) - np.searchsorted(doc, doc)
                ok = np.flatnonzero(n >= shingle)
                if not len(ok):
                    continue
                words = X.span_hash(low, ws, we)
                grams = X.gram_hash(words, shingle)
                full = n[ok] >= min_words  # the others have no bands: equal words share their hash
                each = n[ok[full]] - shingle + 1
                off2 = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
                at = np.repeat(first[ok[full]] - off2[:-1], each) + np.arange(off2[-1])
                sig = _signatures(grams[at], off2, bands, rows) if len(each) else np.zeros((0, bands), np.uint64)
                edges = np.concatenate([[0], np.cumsum(bands * full)]).astype(np.int32)
                # the paragraph's hash: a polynomial of its words
                whole = np.concatenate([[0], np.cumsum(n[ok])])
                pick = np.repeat(first[ok] - whole[:-1], n[ok]) + np.arange(whole[-1])
                rank = np.arange(whole[-1]) - np.repeat(whole[:-1], n[ok])
                with np.errstate(over="ignore"):
                    h = X.mix(np.add.reduceat(words[pick] * X._powers(X.MULT, int(rank.max()) + 1)[rank], whole[:-1])
                              + n[ok].astype(np.uint64))
                raw = data.tobytes()
                text = [raw[a:b] if f else None for a, b, f in zip(s[ok].tolist(), e[ok].tolist(), full.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[ok] + i)), pa.array(place[ok]),
                     pa.array(s[ok] - off[:-1][doc[ok]]), pa.array(e[ok] - off[:-1][doc[ok]]), pa.array(n[ok]),
                     pa.array(h.view(np.int64)),
                     pa.ListArray.from_arrays(edges, pa.array(sig.view(np.int64).ravel())),
                     pa.array(text, pa.binary()).cast(pa.string())],
                    names=["doc", "place", "start", "end", "words", "h", "bands", "text"])
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"doc {kind}, place long, start long, end long, words long, h long, bands array<long>, text string")


def _sets(col: pa.Array, k: int) -> list[np.ndarray]:
    data, off = X.string_buffer(col)
    grams, g_off, _, _ = _shingled(data, off, k)
    return [np.unique(grams[a:b]) for a, b in zip(g_off[:-1], g_off[1:], strict=True)]


def _jaccard(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both)


def _verify(k: int, threshold: float):
    """Rows (a, b, text of a, text of b) -> the pairs that are similar."""
    def run(batches):
        for batch in batches:
            sa, sb = _sets(batch.column(2), k), _sets(batch.column(3), k)
            good = pa.array([_jaccard(x, y, threshold) for x, y in zip(sa, sb, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])
    return run


def _compare(k: int, threshold: float):
    """Rows (same, members x, members y) of (h, c, text) -> links between different components,
    each pair of components linked once a row."""
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py()
                h, c, sets = [], [], []
                for col in (batch.column(1), batch.column(2))[:2 - same]:
                    m = col[r].values
                    h += m.field("h").to_pylist()
                    c += m.field("c").to_pylist()
                    sets += _sets(m.field("text"), k)
                n_x = len(h) if same else len(batch.column(1)[r].values)
                root = {}

                def top(x, root=root):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x
                for i in range(n_x):
                    for j in range(i + 1 if same else n_x, len(h)):
                        p, q = top(c[i]), top(c[j])
                        if p != q and _jaccard(sets[i], sets[j], threshold):
                            root[max(p, q)] = min(p, q)
                            out_a.append(h[i])
                            out_b.append(h[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
    return run


def _key_bits(groups: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** KEY_BITS places (16 MB, whatever the number of keys) with the places of all shared keys."""
    slot = F.col("key").bitwiseAND(F.lit((1 << KEY_BITS) - 1))
    parts = (groups.groupBy(F.shiftright(slot, 15).alias("part"))
             .agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect())
    out = np.zeros(1 << (KEY_BITS - 3), np.uint8)
    for r in parts:
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _holding(shared):
    """Rows (h, bands) -> (h, key) of the keys whose place in the bitmap is set: all shared ones and few others."""
    def run(batches):
        bits = shared.value
        for batch in batches:
            bands = batch.column(1)
            key = bands.flatten().to_numpy(zero_copy_only=False)
            h = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(bands.offsets.to_numpy()))
            slot = key & ((1 << KEY_BITS) - 1)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(key[hit])], names=["h", "key"])
    return run


def clusters(paragraphs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(h, cluster) of the distinct paragraphs that are similar to another; ``cluster`` is its
    smallest hash."""
    paragraphs = paragraphs.where(F.size("bands") > 0)
    distinct = paragraphs.groupBy("h").agg(F.first("bands").alias("bands"))
    keyed = distinct.select("h", F.explode("bands").alias("key"))  # each band has hash functions of its own
    # a paragraph whose band nobody shares leaves here; the counts are combined map-side
    groups = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).where("n > 1"), "paragraph-shared")
    shared = paragraphs.sparkSession.sparkContext.broadcast(_key_bits(groups))
    held = paragraphs.select("h", "bands").mapInArrow(_holding(shared), "h long, key long").distinct()
    members = written(held.join(groups, "key"), "paragraph-groups")
    shared.unpersist()
    pairs = members.where("h != least").select(F.col("least").alias("a"), F.col("h").alias("b")).distinct()
    pairs = written(pairs, "paragraph-pairs")
    wanted = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    texts = written(paragraphs.select("h", "text").join(wanted, "h", "left_semi")
                    .groupBy("h").agg(F.min("text").alias("text")), "paragraph-texts")
    both = (pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("h").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))
    verified = written(both.mapInArrow(_verify(shingle, threshold), "a long, b long"), "paragraph-links")
    group = written(components(verified, name="paragraph-components"), "paragraph-stars")
    # groups whose members are not all connected yet
    placed = (members.join(group, members["h"] == group["node"], "left")
              .select("key", "n", "h", F.coalesce("component", "h").alias("c")))
    open_ = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
    rest = placed.join(open_.select("key"), "key", "left_semi").join(texts, "h")
    rest = rest.where("n > 2")  # two members were compared above
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("blocks", blocks)
    packed = written(rest.groupBy("key", "blocks", "block")
                     .agg(F.sort_array(F.collect_list(F.struct("h", "c", "text"))).alias("m")), "paragraph-blocks")
    x = packed.select("key", F.col("block").alias("i"), F.col("m").alias("x"),
                      F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    y = packed.select("key", F.col("block").alias("j"), F.col("m").alias("y"),
                      F.explode(F.sequence(F.lit(0), "block")).alias("i"))
    tiles = x.join(y, ["key", "i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "x", "y")
    more = tiles.mapInArrow(_compare(shingle, threshold), "a long, b long")
    links = verified.unionByName(more)
    return components(links, name="paragraph-components").select(F.col("node").alias("h"), F.col("component").alias("cluster"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8,
               min_words: int = 20, recall: float = 0.999) -> DataFrame:
    """Every paragraph as (id, place, start, end, words, cluster, size, removed): offsets in bytes,
    ``size`` the number of its cluster's occurrences."""
    bands, rows = tune(threshold, recall)
    paragraphs = written(find(docs, id_col, text_col, shingle, min_words, bands, rows), "paragraphs")
    group = clusters(paragraphs, shingle, threshold)
    own = paragraphs.select("doc", "place", "h").distinct()  # rows that repeat an id are one document
    firsts = own.groupBy("h").agg(F.min(F.struct("doc", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    by_hash = written(firsts.join(group, "h", "left").select("h", "first", "n", F.coalesce("cluster", "h").alias("cluster")),
                      "paragraph-firsts")
    by_cluster = by_hash.groupBy("cluster").agg(F.min("first").alias("first"), F.sum("n").alias("size")).where("size > 1")
    repeated = by_hash.select("h", "cluster").join(by_cluster, "cluster")
    place = F.struct(F.col("doc"), F.col("place"))
    return (paragraphs.drop("bands", "text").join(repeated, "h", "left")
            .select(F.col("doc").alias(id_col), "place", "start", "end", "words", F.coalesce("cluster", "h").alias("cluster"),
                    F.coalesce("size", F.lit(1).cast("long")).alias("size"),
                    F.coalesce(F.col("size").isNotNull() & ~place.eqNullSafe(F.col("first")) & (F.col("words") >= min_words),
                               F.lit(False)).alias("removed")))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the removed paragraphs cut out of the text by their bytes; whole lines go with their
    line break."""
    gone = (duplicates(docs, id_col, text_col, **options).where("removed")
            .groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__gone")))
    raw = F.encode(F.col(text_col), "UTF-8")
    size, zero = F.octet_length(raw).cast("long"), F.lit(0).cast("long")

    def lines(p):
        a, b = p["start"], p["end"]
        breaks = [F.substring(raw, x.cast("int"), F.lit(1)) == F.lit(b"\n") for x in (a, b + 1)]
        whole = ((a == 0) | breaks[0]) & ((b == size) | breaks[1])
        return F.struct(F.when(whole & (b == size) & (a > 0), a - 1).otherwise(a).alias("start"),
                        F.when(whole & (b < size), b + 1).otherwise(b).alias("end"))
    cut = F.transform("__gone", lines)
    starts = F.concat(F.array(zero), F.transform(cut, lambda p: p["end"]))
    ends = F.concat(F.transform(cut, lambda p: p["start"]), F.array(size))
    kept = F.zip_with(starts, ends, lambda a, b: F.decode(
        F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, zero).cast("int")), "UTF-8"))
    return (docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")), "left")
            .withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "")))
            .select(*docs.columns))
