"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents.  Windows of about ``window`` sequences are filled round
by round: in each a source's deficit grows by its quantum, the whole tokens of the deficit are
served (texts are cut freely) and the fraction is carried to the next window.  Quanta follow
the target proportions, by default the sources' shares of all tokens, so every window has the
corpus mixture within one token per source and all queues end together.  With targets of the
caller's, a source that ends early leaves its share to the others; windows stay exact among
the sources still open.

As the served total of a source after window k is floor(k * quantum), each task finds the
windows of its documents from the tokens its queue holds before it: no queue passes through
one task, and deficits carry over windows and partitions alike.  Pass one tokenizes and
writes the ids once, with each document's place in its task's part of the queue; prefix sums
over the (queue, task) totals join the parts; pass two cuts the pieces.

Sequences have ``max_tokens`` ids; the rest after the last full one is cut into sequences whose
lengths are powers of two, so nothing is padded.

Defined results: null or empty text is one end token; null sources form a queue of their own;
repeated documents are packed once per row; ties need no order (queues are in file order); an
empty table gives no pieces; other columns are ignored.  Every source is a queue of its own.  Up to
``max_queues`` their plan is a list on the driver; of more it is a table of what each window
serves of each source, whose prefix sums in the order of windows and sources are the places.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import _text as X
from quarry.llm._io import written

KNOWN_BYTES = 12 << 20  # of known parts, some 300,000; every Python worker of an executor keeps its own
CHUNK_BYTES, ROWS = 1 << 19, 500
_TOKENIZERS: dict = {}
_CODES = np.arange(256)
_OUT, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[X.SPACE] = _OUT
_KIND[((_CODES | 32) >= 97) & ((_CODES | 32) <= 122) & (_CODES < 128)] = _LETTER
_KIND[_CODES >= 128] = _LETTER
_KIND[(_CODES >= 48) & (_CODES <= 57)] = _DIGIT
# second bytes of the Latin-1 letters after the lead byte C3
_SECOND = (_CODES >= 0x80) & (_CODES <= 0xBF) & (_CODES != 0x97) & (_CODES != 0xB7)


class _Words:
    """Ids of texts.  The tokenizer splits at white space, and between letters, digits and other
    signs, before anything else, so a text's ids are those of its parts one after the other and
    each distinct part is encoded once.  Runs with an apostrophe (contractions) or letters beyond
    Latin-1 (composition) are parts as a whole; texts with a special token's string are encoded
    whole.  The ids of known parts are kept in flat arrays under their hashes, anew at a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def known_bytes(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.start, self.count, self.flat))

    def _encode(self, parts: list[bytes], single: np.ndarray) -> list[np.ndarray]:
        """Ids of each part; ``single`` ones are not split further, so many go in one call."""
        out: list = [None] * len(parts)
        one, rest = np.flatnonzero(single).tolist(), np.flatnonzero(~single).tolist()
        for i in range(0, len(one), 512):
            some = one[i:i + 512]
            got = self.tokenizer.encode(b" ".join(parts[k] for k in some).decode("utf-8"), add_special_tokens=False)
            word, ids = np.array(got.word_ids, dtype=np.int64), np.array(got.ids, dtype=np.uint32)
            cut = np.searchsorted(word, np.arange(len(some) + 1))
            if word[-1] != len(some) - 1 or (np.diff(cut) == 0).any():
                rest += some
                continue
            for k, a, b in zip(some, cut[:-1], cut[1:], strict=True):
                out[k] = ids[a:b]
        for i in range(0, len(rest), 512):
            some = rest[i:i + 512]
            got = self.tokenizer.encode_batch([parts[k].decode("utf-8") for k in some], add_special_tokens=False)
            for k, e in zip(some, got, strict=True):
                out[k] = np.array(e.ids, dtype=np.uint32)
        return out

    def _learn(self, h: np.ndarray, parts: list[bytes], single: np.ndarray) -> None:
        ids = self._encode(parts, single)
        count = np.array([len(x) for x in ids], np.int64)
        start = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, *ids])
        at = np.searchsorted(self.hash, h)
        self.hash, self.start, self.count = (np.insert(x, at, y) for x, y in
                                             ((self.hash, h), (self.start, start), (self.count, count)))

    def _parts(self, data: np.ndarray, off: np.ndarray):
        """(lower-cased bytes, starts, ends, kinds) of the parts."""
        kind = _KIND[data]
        low = X.LOWER[data]
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & _SECOND[data[1:]]
        lead = np.zeros(len(data), bool)
        lead[:-1] = second[1:]
        odd = ((data >= 0x80) & ~second & ~lead) | (data == 39)
        if odd.any():
            s, e, _ = X.word_spans(data, off, ~X.SPACE)
            seen = np.concatenate([[0], np.cumsum(odd)])
            whole = seen[e] > seen[s]
            edge = np.zeros(len(data) + 1, np.int64)
            edge[s[whole]] += 1
            edge[e[whole]] -= 1
            inside = np.cumsum(edge[:-1]) > 0
            kind[inside] = _WHOLE
            low[inside] = data[inside]
        turn = kind[1:] != kind[:-1]
        cut = off[1:-1]
        turn[cut[(cut > 0) & (cut < len(data))] - 1] = True
        begin = np.concatenate([[0], np.flatnonzero(turn) + 1])
        end = np.append(begin[1:], len(data))
        k = kind[begin]
        part = k != _OUT
        return low, begin[part], end[part], k[part]

    def _chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        low, s, e, kind = self._parts(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        u, first, back = np.unique(X.span_hash(low, s, e), return_index=True, return_inverse=True)

        at = np.searchsorted(self.hash, u)
        new = np.flatnonzero((at == len(self.hash)) | (np.append(self.hash, np.uint64(0))[at] != u))
        if len(new):
            raw, k = low.tobytes(), kind[first[new]]
            parts = [raw[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)]
            self._learn(u[new], parts, (k == _LETTER) | (k == _OTHER))
        at = np.searchsorted(self.hash, u)[back]
        count = self.count[at]
        before = np.cumsum(count) - count
        ids = self.flat[np.repeat(self.start[at] - before, count) + np.arange(int(count.sum()))]
        if self.known_bytes() > KNOWN_BYTES:
            self.clear()
        return ids, X.segment_sum(count, np.searchsorted(s, off))

    def texts(self, col: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit ids of all texts, each followed by ``end_id``; ids per text)."""
        ids, counts = [], []
        for _, _, data, off in X.chunks(col, CHUNK_BYTES):
            raw = data.tobytes()
            if any(m in raw for m in self.marks):
                each = [self._text(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                got, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            else:
                got, n = self._chunk(data, off)
            ids.append(np.insert(got, np.cumsum(n), np.uint32(end_id)))
            counts.append(n + 1)
        if not counts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _text(self, raw: bytes) -> np.ndarray:
        if any(m in raw for m in self.marks):
            ids = self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids
            return np.array(ids, dtype=np.uint32)
        return self._chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def _words(path: str) -> _Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Words(path)
    return _TOKENIZERS[path]


_TOKENIZED = "doc_id {id}, source string, part int, before long, n long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its ids with ``end_id`` (32-bit little-endian), its task and the
    tokens that its source has before it in that task.  Written, hence stable."""
    def run(batches):
        words, part, served = _words(tokenizer), TaskContext.get().partitionId(), {}
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            ids, n = words.texts(batch.column(1), end_id)
            before = []
            for s, k in zip(batch.column(2).to_pylist(), n.tolist(), strict=True):
                before.append(served.get(s, 0))
                served[s] = before[-1] + k
            edges = np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges),
                                                               pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.string()), pa.array([part] * len(n), pa.int32()),
                 pa.array(before, pa.int64()), pa.array(n, pa.int64()), blob],
                names=["doc_id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(source_col).cast("string").alias("source"))
    schema = _TOKENIZED.format(id=dict(rows.dtypes)["doc_id"])
    return written(rows.mapInArrow(run, schema), "packing-ids")


class Rounds:
    """The tokens each queue has been served after each window."""

    def __init__(self, totals: list[int], window_tokens: int, weights: list[float] | None = None):
        self.total = np.array(totals, dtype=np.int64)
        self.all = int(self.total.sum())
        self.weights = None
        if weights is None:
            self.windows = max(1, round(self.all / window_tokens))
            self.whole, self.part = self.total // self.windows, self.total % self.windows
        else:
            w = np.array(weights, dtype=np.float64)
            if (w <= 0).any():
                raise ValueError("target proportions must be positive")
            self.weights, self.window_tokens = w, window_tokens
            # progress at which each queue ends, and the tokens served of all queues by then
            ends = self.total / w
            self.knots = np.concatenate([[0.0], np.sort(ends)])
            self.served_at = np.array([np.minimum(self.total, w * t).sum() for t in self.knots])
            self.windows = max(1, -(-self.all // window_tokens))

    def served(self, k: int) -> np.ndarray:
        """Tokens of each queue in the first ``k`` windows."""
        if k >= self.windows:
            return self.total
        if self.weights is None:
            return k * self.whole + k * self.part // self.windows
        t = np.interp(k * self.window_tokens, self.served_at, self.knots)
        return np.minimum(self.total, np.floor(self.weights * t).astype(np.int64))

    def window_of(self, queue: int, x: int) -> int:
        """The window that serves token ``x`` of a queue."""
        lo, hi = 0, self.windows - 1
        if self.weights is None and self.total[queue]:
            guess = int(x * self.windows // int(self.total[queue]))
            lo, hi = max(0, guess - 1), min(self.windows - 1, guess + 1)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.served(mid + 1)[queue] > x:
                hi = mid
            else:
                lo = mid + 1
        return lo


class Shares:
    """What each window serves of one source, from the source's tokens ``n`` and weight ``w`` alone."""

    def __init__(self, total: int, window_tokens: int, named: list[tuple[int, float]] | None = None):
        self.progress = None
        if named is None:
            self.windows = max(1, round(total / window_tokens))
            return
        # sources without a target weigh as their share, hence end together: one queue for the progress
        rest = total - sum(n for n, _ in named)
        queues = named + [(rest, rest / total)] * (rest > 0)
        rounds = Rounds([n for n, _ in queues], window_tokens, [w for _, w in queues])
        self.windows = rounds.windows
        self.progress = np.interp(np.arange(self.windows + 1) * window_tokens, rounds.served_at, rounds.knots)

    def served(self, k: np.ndarray, n: int, w: float) -> np.ndarray:
        """Tokens of the source in the first ``k`` windows."""
        if self.progress is None:
            return k * (n // self.windows) + k * (n % self.windows) // self.windows
        return np.where(k >= self.windows, n, np.minimum(n, np.floor(w * self.progress[k]).astype(np.int64)))

    def window_of(self, x: np.ndarray, n: int, w: float) -> np.ndarray:
        """The windows that serve tokens ``x``: the last ones with at most ``x`` served before."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.windows - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.served(mid, n, w) <= x
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def pieces(self, x: int, m: int, n: int, w: float) -> list[tuple[int, int, int, int]]:
        """(window, served of the source before it, start, end) of tokens ``x`` to ``x + m``."""
        first, last = self.window_of(np.array([x, x + m - 1]), n, w).tolist()
        if m < last - first:
            k = np.unique(self.window_of(np.arange(x, x + m), n, w))
        else:
            k = np.arange(first, last + 1)
        before = self.served(k, n, w)
        a, b = np.maximum(before, x), np.minimum(self.served(k + 1, n, w), x + m)
        return [p for p in zip(k.tolist(), before.tolist(), a.tolist(), b.tolist(), strict=True) if p[3] > p[2]]


def _pack_by_table(rows: DataFrame, sums: DataFrame, by_source: DataFrame, total: int, max_tokens: int, window: int,
                   targets: dict[str, float] | None, names: list[str], with_ids: bool) -> DataFrame:
    """The pieces where the sources are too many for a list on the driver."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["doc_id"]
    named = None
    if targets is not None:
        wanted = F.col("source").isin([s for s in targets if s is not None])
        if None in targets:
            wanted = wanted | F.col("source").isNull()
        named = [(r["n"], float(targets[r["source"]])) for r in by_source.where(wanted).collect()]  # the caller's targets
        named = sorted(named)
    shares = Shares(total, window * max_tokens, named)

    def weight(source, n):
        return 0.0 if targets is None else float(targets.get(source, n / total))

    def serve(batches):
        for batch in batches:
            for source, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = shares.pieces(0, n, n, weight(source, n))
                for i in range(0, len(got), 10_000):
                    some = got[i:i + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([source] * len(some), pa.string()), pa.array([p[0] for p in some], pa.int64()),
                         pa.array([p[3] - p[2] for p in some], pa.int64())], names=["source", "k", "c"])

    def add_up(batches):
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            c = batch.column(2).to_numpy()
            before = done + np.cumsum(c) - c
            done += int(c.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(before),
                                              pa.array([part] * len(c), pa.int32())], names=["source", "k", "c", "before", "part"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = written(by_source.select("source", "n").mapInArrow(serve, "source string, k long, c long"), "packing-turns")
    turns = turns.repartitionByRange(tasks, "k", "source").sortWithinPartitions("k", "source")
    turns = written(turns.mapInArrow(add_up, "source string, k long, c long, before long, part int"), "packing-places")
    ends = sorted(turns.groupBy("part").agg(F.sum("c").alias("c")).collect())  # one row a task
    upto = np.cumsum([0] + [r["c"] for r in ends]).tolist()
    offsets = spark.createDataFrame([(r["part"], b) for r, b in zip(ends, upto)], "part int, offset long")
    places = turns.join(F.broadcast(offsets), "part").select("source", "k", (F.col("before") + F.col("offset")).alias("g"))
    w = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    placed = rows.join(base, rows["source"].eqNullSafe(base["source"]) & (rows["part"] == base["part"])).select(
        "doc_id", rows["source"].alias("source"), (F.col("base") + F.col("before")).alias("x"), "n", "ids")
    whole = by_source.select(F.col("source").alias("s"), F.col("n").alias("all"))
    placed = placed.join(whole, placed["source"].eqNullSafe(whole["s"])).select("doc_id", "source", "x", "n", "all", "ids")

    def split(batches):
        for batch in batches:
            which, cols = [], ([], [], [], [])
            source, x, n, every, ids = (batch.column(i).to_pylist() for i in range(1, 6))
            for i in range(batch.num_rows):
                for k, before, a, b in shares.pieces(x[i], n[i], every[i], weight(source[i], every[i])):
                    which.append(i)
                    for c, v in zip(cols, (k, a - before, a - x[i], ids[i][4 * (a - x[i]):4 * (b - x[i])]), strict=True):
                        c.append(v)
            pick = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).take(pick) for j in (0, 1, 3)] + [pa.array(c, pa.int64()) for c in cols[:3]]
                + [pa.array(cols[3], pa.binary())], names=["doc_id", "source", "n", "k", "into", "start", "ids"])
    parts = placed.mapInArrow(split, f"doc_id {kind}, source string, n long, k long, into long, start long, ids binary")
    parts = parts.join(places, parts["source"].eqNullSafe(places["source"]) & (parts["k"] == places["k"])).select(
        "doc_id", parts["source"].alias("source"), "n", parts["k"].alias("k"), (F.col("g") + F.col("into")).alias("g"), "start", "ids")

    def cut(batches):
        for batch in batches:
            which, got, bits = [], {n: [] for n in names[2:]}, []
            ns, ks, gs, starts, ids = (batch.column(j).to_pylist() for j in range(2, 7))
            for i in range(batch.num_rows):
                done, upto = 0, len(ids[i]) // 4
                while done < upto:
                    seq, offset, room = sequence_of(gs[i] + done, total, max_tokens)
                    length = min(room, upto - done)
                    piece = ids[i][4 * done:4 * (done + length)]
                    which.append(i)
                    bits.append(piece)
                    for name, v in zip(names[2:], (starts[i] + done, length, zlib.crc32(piece), ns[i], seq, offset, ks[i]), strict=True):
                        got[name].append(v)
                    done += length
            pick = pa.array(which, pa.int64())
            cols = [batch.column(0).take(pick), batch.column(1).take(pick)]
            cols += [pa.array(got[n], pa.int64()) for n in names[2:]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(bits, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
    schema = f"doc_id {kind}, source string, " + ", ".join(f"{n} long" for n in names[2:]) + ", ids binary" * with_ids
    return parts.mapInArrow(cut, schema)


def sequence_of(g: int, total: int, size: int) -> tuple[int, int, int]:
    """(sequence, offset there, ids until its end) of the ``g``-th id of all."""
    full = total // size
    if g < full * size:
        return g // size, g % size, size - g % size
    at, seq, rest = full * size, full, total % size
    while True:
        part = 1 << (rest.bit_length() - 1)
        if g < at + part:
            return seq, g - at, at + part - g
        at, seq, rest = at + part, seq + 1, rest - part


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, window: int = 32, end_id: int = 1,
         targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", max_queues: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    window_id[, ids]).  ``targets``: weight of each source; sources without one weigh as their
    share of the tokens; None: corpus shares."""
    rows = tokenize(docs, tokenizer, end_id, id_col, text_col, source_col)
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    sums = written(sums, "packing-sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id"]
    size = by_source.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n")).first()
    if size["sources"] > max_queues:
        return _pack_by_table(rows, sums, by_source, size["n"], max_tokens, window, targets, names, with_ids)
    queue = F.col("source")
    plan = by_source.select(queue.alias("queue"), "n").collect()  # <= max_queues rows
    plan = sorted(plan, key=lambda r: (r["queue"] is not None, r["queue"]))
    total = sum(r["n"] for r in plan)
    weights = None if targets is None else [float(targets.get(r["queue"], r["n"] / max(1, total))) for r in plan]
    rounds = Rounds([r["n"] for r in plan], window * max_tokens, weights)
    at = {r["queue"]: i for i, r in enumerate(plan)}
    w = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = (sums.withColumn("queue", queue)
            .select("queue", "source", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")))
    placed = rows.join(base, rows["source"].eqNullSafe(base["source"]) & (rows["part"] == base["part"]))
    placed = placed.select("doc_id", rows["source"].alias("source"), "queue",
                           (F.col("base") + F.col("before")).alias("x"), "n", "ids")

    def cut(batches):
        for batch in batches:
            got = {n: [] for n in names[2:]}
            which, bits = [], []
            queues, xs, ns, ids = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            for i in range(batch.num_rows):
                q, x, n, raw = at[queues[i]], xs[i], ns[i], ids[i]
                k, start = rounds.window_of(q, x), 0
                while start < n:
                    old, new = rounds.served(k), rounds.served(k + 1)
                    upto = min(n, int(new[q]) - x)
                    # queues of lower number come first in a window, those of higher number after
                    g = int(new[:q].sum() + old[q:].sum()) + (x + start - int(old[q]))
                    while start < upto:
                        seq, offset, room = sequence_of(g, total, max_tokens)
                        length = min(room, upto - start)
                        piece = raw[4 * start:4 * (start + length)]
                        which.append(i)
                        bits.append(piece)
                        for name, v in zip(names[2:], (start, length, zlib.crc32(piece), n, seq, offset, k), strict=True):
                            got[name].append(v)
                        start, g = start + length, g + length
                    k += 1
            pick = pa.array(which, pa.int64())
            cols = [batch.column(0).take(pick), batch.column(1).take(pick)]
            cols += [pa.array(got[n], pa.int64()) for n in names[2:]]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(bits, pa.binary())] * with_ids,
                                             names=names + ["ids"] * with_ids)

    schema = (f"doc_id {dict(rows.dtypes)['doc_id']}, source string, "
              + ", ".join(f"{n} long" for n in names[2:]) + ", ids binary" * with_ids)
    return placed.mapInArrow(cut, schema)
