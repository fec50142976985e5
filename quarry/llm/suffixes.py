"""Removal of long repeated byte strings with a run-length index.

A byte goes if a ``length``-byte string over it also starts somewhere else in the corpus.  Texts
are first sampled: of every window of ``length`` bytes the ``anchor``-byte string of smallest hash
is an anchor, so equal windows have an anchor of one hash, and the context of an anchor (the
windows that it is the smallest of) tells everything about them.  Anchors that occur once are done with.  Equal
contexts are counted, map-side combined: one that occurs twice is repeated from end to end.
Contexts that share an anchor and differ otherwise may still share windows: the windows are taken
in ``STEPS`` groups of near places, and what all windows of a group have in common is hashed; a
context none of whose groups is met elsewhere is done with too.  The others are compared in
bounded sets of anchors: their texts (one copy of every context, overlapping ones of a document
joined) go into a run-length index - the Burrows-Wheeler transform in runs, with the suffixes at
the ends of runs sampled.  The longest common prefixes at these ends, streamed along the text (one
less at every step), are the matching statistics of all positions, and those of at least
``length`` mark repeated strings.

Anchors that still have more than ``hot`` different contexts are compared without gathering them:
a group of windows that another context has as a whole is repeated as a whole, and the windows of
the others are hashed and counted one by one, map-side combined, by exact place.

Passages are also sought by words, whatever bytes they take: of every window of ``words`` words the
string of half of them (and one) with the smallest hash is taken, and those that another row has
too are counted.  Nothing is removed for them.

Defined results: null text is empty; texts shorter than ``length`` stay whole; repeated rows
repeat one another; null ids are ordinary values; an empty table gives an empty result; other
columns pass through ``clean`` unless they bear a result's name.  A text is known by a 64-bit hash
of its id and itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as X
from quarry.llm._io import written

INDEX_BYTES = 1 << 18
STEPS = 8  # groups of a context's windows
SIEVE_BITS = 1 << 22
COMMON = 4096  # contexts sent to all tasks at most


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some regions, with the text positions at both
    ends of each run boundary and the common prefix across it."""

    def __init__(self, regions: list[np.ndarray]):
        size = np.array([len(r) + 1 for r in regions], np.int64)
        end = np.cumsum(size) - 1  # separators, each a symbol of its own
        n = int(size.sum())
        start = end - size + 1
        symbol = np.concatenate([np.append(r.astype(np.int64) + 1, 0) for r in regions])
        self.rest = np.repeat(end, size) - np.arange(n)  # symbols before the separator
        self.start = start
        self.symbols = symbol
        order, ranks, first = self._sort(symbol, n)
        before = np.where(order > 0, symbol[order - 1], -1)
        before = np.where(before == 0, -2 - order, before)  # separators differ from one another
        head = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.runs = before[np.concatenate([[0], head])]  # the transform, a symbol a run
        self.run_start = np.concatenate([[0], head])
        self.last, self.first = order[head - 1], order[head]  # sampled run ends
        self.common = self._common(ranks, first, self.last, self.first)

    def _sort(self, symbol: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], int]:
        """The suffixes in order, (depth, how many of it the next depth has, rank of every suffix by that many
        symbols) until all differ, and the first depth.  Only suffixes that share a rank are sorted
        again.  A suffix whose separator comes sooner has a rank of its own."""
        present = np.flatnonzero(np.bincount(symbol, minlength=257))
        code = np.zeros(257, np.int64)
        code[present] = np.arange(len(present))  # the separator, the smallest, stays 0
        key, first = code[symbol], 1  # symbols packed into the first ranks: as many as fit
        while 2 * first * np.log2(max(len(present), 2)) < 62:
            far = np.append(key[first:], np.zeros(min(first, n), np.int64))
            key = key * len(present) ** first + np.where(self.rest >= first, far, 0)
            first *= 2
        depth, out = first, []
        parts = 3 if n < 1 << 21 else 2  # ranks that fit one key
        order = np.argsort(key)
        k = key[order]
        new = np.ones(n, bool)
        new[1:] = (k[1:] != k[:-1]) | (self.rest[order[1:]] < depth) | (self.rest[order[:-1]] < depth)
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while True:
            out.append((depth, parts, rank))
            slot = np.flatnonzero(~(new & np.append(new[1:], True)))  # of those that share a rank
            if not len(slot):
                return order, out, first
            at = order[slot]
            key = rank[at].astype(np.int64)
            for j in range(1, parts):
                far = at + j * depth
                key = key * n + np.where(self.rest[at] >= j * depth, rank[np.minimum(far, n - 1)], 0)
            again = np.argsort(key)
            order[slot] = at = at[again]
            k = key[again]
            new[slot[1:]] = k[1:] != k[:-1]
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(new[slot], slot, 0))
            depth *= parts

    def _common(self, ranks, first: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, by the ranks of all depths."""
        common = np.zeros(len(a), np.int64)
        for depth, parts, rank in reversed(ranks):
            for _ in range(parts - 1):
                ok = (self.rest[a] - common >= depth) & (self.rest[b] - common >= depth)
                i, j = a + np.where(ok, common, 0), b + np.where(ok, common, 0)
                common += np.where(ok & (rank[i] == rank[j]), depth, 0)
        # less than the first depth is left: symbol by symbol
        for _ in range(first):
            ok = (self.rest[a] > common) & (self.rest[b] > common)
            i, j = np.where(ok, a + common, 0), np.where(ok, b + common, 0)
            common += ok & (self.symbols[i] == self.symbols[j])
        return common

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every position elsewhere: streamed from the sampled run ends."""
        n = len(self.rest)
        known = np.zeros(n, np.int64)
        np.maximum.at(known, self.first, self.common)
        np.maximum.at(known, self.last, self.common)
        at = np.arange(n)
        # a match of length m at i is one of m - 1 at i + 1; starts of regions begin anew
        carried = np.maximum.accumulate(known + at) - at
        return np.minimum(carried, self.rest)


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every run of ``w`` consecutive values."""
    n = len(x) - w + 1
    fill = np.iinfo(x.dtype).max if least else 0
    op = np.minimum if least else np.maximum
    padded = np.full(-(-len(x) // w) * w, fill, x.dtype)
    padded[:len(x)] = x
    rows = padded.reshape(-1, w)
    fore = op.accumulate(rows, axis=1).ravel()
    back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], fore[w - 1:w - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, length: int, k: int, pre: np.ndarray):
    """(position, hash, first and last window) of the anchors of some texts (bytes or hashes of words),
    whose prefix sums are ``pre``: the windows that an anchor is the least of are neighbours."""
    n = len(data)
    none = np.zeros(0, np.int64)
    w = length - k + 1
    if n < length:
        return none, none.astype(np.uint64), none, none
    at = np.arange(n - k + 1)
    with np.errstate(over="ignore"):
        g = X.mix((pre[at + k] - pre[at]) * X._powers(X.MULT_INV, n + 1)[at]) | np.uint64(1)
    least = _slide(g, w, True)
    # only windows inside one text count
    size = np.diff(off)
    text = np.repeat(np.arange(len(size)), size)
    inside = text[:n - length + 1] == text[length - 1:]
    least = np.where(inside, least, np.uint64(0))
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    pick = np.flatnonzero(_slide(around, w, False) == g)
    # of the runs of windows with one least hash, the anchor's is the first of its hash that ends in reach
    run = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.append(run[1:], len(least)) - 1
    kind, of = np.unique(least[run], return_inverse=True)
    order = np.lexsort((last, of))
    at = np.searchsorted((of * n + last)[order], np.searchsorted(kind, g[pick]) * n + np.maximum(pick - w + 1, 0))
    mine = order[at]
    return pick, g[pick], np.maximum(run[mine], pick - w + 1), np.minimum(last[mine], pick)


def _shape(length: int, before, size):
    """A context's size and its anchor's place in it as one number; ``_place`` and ``_size`` take it apart."""
    return before * (2 * length) + size


def _place(length: int, shape):
    return shape // (2 * length)


def _size(length: int, shape):
    return shape % (2 * length)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, text): ``d`` stands for a text and its id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.xxhash64(F.col(id_col), text).alias("d"), text.alias("text"))


def occurrences(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Every anchor: its text, the start and shape of its context, and the hashes of the anchor and of
    the context with the anchor's place in it."""
    def run(batches):
        for batch in batches:
            for i, _, data, off in X.chunks(batch.column(1), 1 << 18):
                pre = X.prefix_hash(data)
                pos, a, lo, last = anchors(data, off, length, k, pre)
                if not len(pos):
                    continue
                doc = np.searchsorted(off, pos, side="right") - 1
                hi = last + length
                with np.errstate(over="ignore"):
                    c = X.mix(X.span_hash(data, lo, hi, pre) + (pos - lo).astype(np.uint64) * X.GRAM_KEY[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc + i)), pa.array((lo - off[doc]).astype(np.int32)),
                     pa.array(_shape(length, pos - lo, hi - lo)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))],
                    names=["d", "lo", "shape", "a", "c"])
    return texts.mapInArrow(run, "d long, lo int, shape long, a long, c long")


def _steps(length: int, k: int) -> list[tuple[int, int]]:
    """Groups of the windows that hold an anchor, by the anchor's place in them: (first, last)."""
    edge = np.linspace(0, length - k + 1, STEPS + 1).round().astype(int)
    return [(int(x), int(y) - 1) for x, y in zip(edge[:-1], edge[1:], strict=True) if y > x]


def _cutter(length: int, k: int):
    """Rows (text, its wanted contexts) -> (a, c, d, lo, shape, bytes, cores, hulls): hashes of what the
    windows of each group have in common (null: the context has none of them), and of all they cover
    that the context has."""
    groups = _steps(length, k)

    def run(batches):
        for batch in batches:
            for i, j, data, off in X.chunks(batch.column(2), 1 << 18):
                yield chunk(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), data, off)

    def chunk(d: pa.Array, wanted: pa.Array, data: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        flat = wanted.flatten()
        row = np.repeat(np.arange(len(d)), np.asarray(wanted.value_lengths()))
        lo, shape = np.asarray(flat.field("lo")).astype(np.int64), np.asarray(flat.field("shape"))
        place, hi = _place(length, shape), lo + _size(length, shape)
        pos = lo + place
        pre = X.prefix_hash(data)
        first, last = length - (hi - pos), place
        cores, hulls = np.zeros((2, len(row), len(groups)), np.uint64)
        there = np.zeros(cores.shape, bool)
        for g, (x, y) in enumerate(groups):
            ok = np.flatnonzero((first <= y) & (last >= x))
            there[ok, g] = True
            begin = off[row[ok]] + pos[ok] - x
            with np.errstate(over="ignore"):
                cores[ok, g] = X.mix(X.span_hash(data, begin, begin + length - (y - x), pre) + X.GRAM_KEY[g])
            near, far = np.maximum(first[ok], x), np.minimum(last[ok], y)
            begin = off[row[ok]] + pos[ok]
            with np.errstate(over="ignore"):
                hulls[ok, g] = X.mix(X.span_hash(data, begin - far, begin - near + length, pre)
                                     + near.astype(np.uint64) * X.GRAM_KEY[g])
        raw, base = data.tobytes(), off[row]
        cut = [raw[x:y] for x, y in zip((base + lo).tolist(), (base + hi).tolist(), strict=True)]
        edges = np.arange(0, cores.size + 1, len(groups), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [flat.field("a"), flat.field("c"), d.take(pa.array(row)), flat.field("lo"), flat.field("shape"),
             pa.array(cut, pa.binary()),
             *[pa.ListArray.from_arrays(edges, pa.array(x.view(np.int64).ravel(), mask=~there.ravel()))
               for x in (cores, hulls)]],
            names=["a", "c", "d", "lo", "shape", "bytes", "cores", "hulls"])
    return run


def _indexed(length: int):
    """Contexts sorted by anchor -> the repeated runs of their texts, by an index of up to
    ``INDEX_BYTES`` of them that never parts an anchor's contexts."""
    def solve(rows: list):
        # one copy of each stretch of a text: overlapping contexts are joined
        rows.sort(key=lambda r: (r[2], r[3]))
        regions, where, key, upto = [], [], None, 0
        for _, _, d, lo, raw in rows:
            if key != d or lo > upto:
                regions.append([raw])
                key, begin, upto = d, lo, lo + len(raw)
            elif lo + len(raw) > upto:
                regions[-1].append(raw[upto - lo:])
                upto = lo + len(raw)
            where.append((len(regions) - 1, lo - begin))
        index = RunLengthIndex([np.frombuffer(b"".join(r), np.uint8) for r in regions])
        starts = index.matching_statistics() >= length
        hit = np.flatnonzero(starts)
        at = np.array([int(index.start[r]) + o for r, o in where])
        low = np.searchsorted(hit, at)
        high = np.searchsorted(hit, at + np.array([len(row[4]) for row in rows]) - length + 1) - 1
        some = np.flatnonzero(high >= low)
        if not len(some):
            return None
        far = np.flatnonzero(np.diff(hit) > length) + 1  # first hits of runs
        run_first, run_last = np.append(0, far), np.append(far, len(hit)) - 1
        x = np.searchsorted(far, low[some], side="right")
        count = np.searchsorted(far, high[some], side="right") - x + 1
        row = np.repeat(some, count)
        one = np.arange(len(row)) - np.repeat(np.cumsum(count) - count - x, count)
        d, lo = (np.array([r[j] for r in rows], np.int64) for j in (2, 3))
        back = (lo - at)[row]
        start = hit[np.maximum(run_first[one], low[row])] + back
        end = hit[np.minimum(run_last[one], high[row])] + length + back
        return pa.RecordBatch.from_arrays([pa.array(d[row]), *[pa.array(x.astype(np.int32)) for x in (start, end)]],
                                          names=["d", "start", "end"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if size >= INDEX_BYTES and row[0] != rows[-1][0]:
                    got = solve(rows)
                    if got is not None:
                        yield got
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            got = solve(rows)
            if got is not None:
                yield got
    return run


def _windows(length: int, k: int):
    """Contexts with groups that are met -> every window of these: (hash, text and place)."""
    groups = _steps(length, k)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                yield part(whole.slice(at, 512))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        d, lo, shape, raw, met = batch.columns
        raw = raw.to_pylist()
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(met.value_lengths()))
        ends = np.array(groups)[np.asarray(met.flatten())] if len(row) else np.zeros((0, 2), int)
        place = _place(length, np.asarray(shape))[row]  # of the anchor
        size = np.diff(off)[row]
        first = np.maximum(ends[:, 0], length - (size - place))
        last = np.minimum(ends[:, 1], place)
        count = np.maximum(last - first + 1, 0)
        each = np.repeat(np.arange(len(row)), count)
        begin = place[each] - (first[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count))
        s = off[row[each]] + begin
        h, take = X.span_hash(data, s, s + length), pa.array(row[each])
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), d.take(take), pa.array((np.asarray(lo)[row[each]] + begin).astype(np.int32))],
            names=["h", "d", "at"])
    return run


def _perhaps(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` with ``__perhaps``: whether the hash ``key`` may be one of ``keys`` (its only column); only
    such rows need to move to meet it.  Tasks get ``SIEVE_BITS`` bits, whatever the table's size."""
    def bit(name):
        return F.pmod(F.col(name), F.lit(SIEVE_BITS)) + 1
    own, at = keys.columns[0], F.bitmap_bit_position(bit(key))
    sieve = (keys.groupBy(F.bitmap_bucket_number(bit(own)).alias("__bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(own))).alias("__bits")))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("__bucket", F.bitmap_bucket_number(bit(key))).join(F.broadcast(sieve), "__bucket", "left")
            .withColumn("__perhaps", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__bucket", "__bits"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
             anchor: int = 200, hot: int = 400) -> DataFrame:
    """(d, runs): the repeated runs [start, end) in bytes (they may overlap) of every text that has
    any; ``d`` is xxhash64 of id and text."""
    texts = _texts(docs, id_col, text_col)
    found = written(occurrences(texts, length, anchor), "suffix-anchors")
    # written, so that the join below is one of two plain exchanges and splits a hot anchor
    again = written(found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "suffix-again")
    live = written(found.join(again, "a", "left_semi"), "suffix-repeated")
    contexts = written(live.groupBy("a", "c").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in ("d", "lo", "shape")]), "suffix-contexts")
    lo, size, place = F.col("lo"), F.col("shape") % (2 * length), F.floor(F.col("shape") / (2 * length))

    def runs_of(marked, start, end):
        return marked.select("d", start.cast("int").alias("start"), end.cast("int").alias("end"))
    # a context that occurs twice needs no more: its runs below are parts of these; occurrences of the
    # commonest contexts (at most COMMON) stay where they are, so none gathers in a task
    least = live.count() // COMMON + 1
    common = F.broadcast(contexts.where((F.col("n") > 1) & (F.col("n") >= least)).select("a", "c"))
    twice = contexts.where((F.col("n") > 1) & (F.col("n") < least)).select("a", "c")
    full = runs_of(live.join(common, ["a", "c"], "left_semi").unionByName(
        live.join(common, ["a", "c"], "left_anti").join(twice, ["a", "c"], "left_semi")), lo, lo + size)
    # the text of one occurrence of every context whose anchor has others (repeated from end to end
    # or not: it may be another's only match)
    several = contexts.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a")
    wanted = (contexts.join(several, "a", "left_semi")
              .groupBy("d").agg(F.collect_list(F.struct("a", "c", "lo", "shape")).alias("wanted")))
    wanted = written(wanted, "suffix-wanted")
    held = _perhaps(texts, "d", wanted.select("d")).where("__perhaps")
    cut = (wanted.join(held, "d").select("d", "wanted", "text")
           .mapInArrow(_cutter(length, anchor), "a long, c long, d long, lo int, shape long, bytes binary, "
                       "cores array<long>, hulls array<long>"))
    cut = written(cut, "suffix-texts")
    core = (cut.select("a", "c", "shape", F.posexplode(F.arrays_zip("cores", "hulls")).alias("g", "x"))
            .where("x.cores is not null")
            .select("a", "c", "shape", "g", F.col("x.cores").alias("h"), F.col("x.hulls").alias("u")))
    shared = core.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    met = written(core.join(shared, "h", "left_semi").drop("h"), "suffix-met")
    # contexts with a group that is met; texts move only to the contexts chosen by these narrow rows
    alive = written(met.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")).select("a", "c"), "suffix-alive")
    kinds = written(alive.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")), "suffix-kinds")
    chosen = alive.join(kinds.where(F.col("kinds") <= hot).select("a"), "a", "left_semi")
    heated = kinds.where(F.col("kinds") > hot).select("a")

    def perhaps_hot(rows):
        return _perhaps(rows, "a", heated).where("__perhaps").drop("__perhaps")
    few = cut.select("a", "c", "d", "lo", "bytes").join(chosen, ["a", "c"], "left_semi")
    indexed = (few.repartition("a").sortWithinPartitions("a")
               .mapInArrow(_indexed(length), "d long, start int, end int"))
    # hot anchors: a group whose windows another context has as a whole is repeated as a whole, and one
    # copy of it stands for the others where the windows of the remaining groups are counted one by one
    many = written(perhaps_hot(met).join(heated, "a", "left_semi"), "suffix-many")
    hulls = written(many.groupBy("u").agg(F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in ("a", "c", "g")]),
                    "suffix-hulls")
    first, last = (F.array(*[F.lit(x[j]) for x in _steps(length, anchor)]) for j in (0, 1))
    whole = (many.join(hulls.where("n > 1").select("u"), "u", "left_semi").drop("shape")
             .join(perhaps_hot(contexts).select("a", "c", "d", "lo", "shape"), ["a", "c"]))
    whole = runs_of(whole, lo + place - F.least(F.get(last, F.col("g")), place),
                    lo + place - F.greatest(F.get(first, F.col("g")), length - size + place) + length)
    open_ = hulls.groupBy("a", "c").agg(F.collect_set("g").alias("met"))
    windows = written(perhaps_hot(cut.drop("cores", "hulls")).join(open_, ["a", "c"])
                      .select("d", "lo", "shape", "bytes", "met")
                      .mapInArrow(_windows(length, anchor), "h long, d long, at int"),
                      "suffix-windows")
    spot = F.struct("d", "at")
    met_twice = windows.groupBy("h").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x != y").select("h")
    counted = runs_of(windows.join(met_twice, "h", "left_semi"), F.col("at"), F.col("at") + length)
    runs = full.unionByName(indexed).unionByName(counted).unionByName(whole)
    return runs.groupBy("d").agg(F.collect_list(F.struct("start", "end")).alias("runs"))


def shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 51) -> DataFrame:
    """(d, n_shared): for texts that have any, how many of their strings of ``words // 2 + 1`` words, the
    smallest by hash in a window of ``words`` words, another row has too.  A run of ``words`` words that
    stands in two rows has one at least; a shorter run may have one."""
    def run(batches):
        for batch in batches:
            for i, _, data, off in X.chunks(batch.column(1), 1 << 18):
                start, end, first = X.word_spans(data, off, ~X.SPACE)
                word = X.span_hash(data, start, end)
                with np.errstate(over="ignore"):
                    pre = np.append(np.uint64(0), np.cumsum(word * X._powers(X.MULT, len(word)), dtype=np.uint64))
                pos, h, _, _ = anchors(word, first, words, words // 2 + 1, pre)
                if not len(pos):
                    continue
                doc = np.searchsorted(first, pos, side="right") - 1
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[once] + i)), pa.array(h[once].view(np.int64))],
                                                 names=["d", "h"])
    found = written(_texts(docs, id_col, text_col).mapInArrow(run, "d long, h long"), "suffix-passages")
    # written, so that the join splits a passage that many texts have
    again = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "suffix-passages-again")
    return found.join(again, "h", "left_semi").groupBy("d").agg(F.size(F.collect_set("h")).cast("long").alias("n_shared"))


_CLEANED = "n_bytes long, n_removed long, n_spans long, kept binary"


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 51,
          **options) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (what
    is left of the text, as bytes), ``kept_sha256`` and ``n_shared`` (``shared``)."""
    runs = written(repeated(docs, id_col, text_col, length, **options)
                   .join(shared(docs, id_col, text_col, words), "d", "full"), "suffix-runs")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    keyed = (docs.drop("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "n_shared")
             .withColumn("__d", F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))))
    keyed = _perhaps(keyed, "__d", runs.select("d"))
    found = runs.select(F.col("d").alias("__d"), F.col("runs").alias("__runs"), F.col("n_shared").alias("__shared"))
    joined = (keyed.where("__perhaps").join(found, "__d", "left")
              .unionByName(keyed.where("not __perhaps"), allowMissingColumns=True).drop("__perhaps"))

    @F.arrow_udf(_CLEANED)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        data, off = X.string_buffer(text)
        raw = data.tobytes()
        edge = np.concatenate([[0], np.cumsum(np.asarray(spans.value_lengths().fill_null(0)))]).astype(np.int64)
        flat = spans.flatten()
        begin, end = np.asarray(flat.field("start"), np.int64), np.asarray(flat.field("end"), np.int64)
        size, removed, number, kept = np.diff(off), [], [], []
        for i in range(len(text)):
            s, e = begin[edge[i]:edge[i + 1]], end[edge[i]:edge[i + 1]]
            own = raw[off[i]:off[i + 1]]
            if len(s):
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[0], np.flatnonzero(s[1:] > e[:-1]) + 1])
                s, e = s[new], e[np.append(new[1:], len(s)) - 1]
                own = b"".join(own[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(own)], strict=True))
            removed.append(int(size[i]) - len(own))
            number.append(len(s))
            kept.append(own)
        return pa.StructArray.from_arrays([pa.array(size), pa.array(removed, pa.int64()), pa.array(number, pa.int64()),
                                           pa.array(kept, pa.binary())], names=["n_bytes", "n_removed", "n_spans", "kept"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (joined.withColumn("__cut", cut(text, F.coalesce("__runs", empty))).drop("__d", "__runs")
            .select("*", "__cut.*").drop("__cut").withColumn("kept_sha256", F.sha2("kept", 256))
            .withColumn("n_shared", F.coalesce("__shared", F.lit(0).cast("long"))).drop("__shared"))
