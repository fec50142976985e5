"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints: texts are lower-cased (A-Z), words are runs of bytes other than ASCII white
space, every run of ``shingle`` words (repeats included; fewer words: all of them) is hashed
with XXH64 seed 42, and a bit is 1 if it is set in over half of the hashes.

Links (at most ``max_bits`` differing bits) are found between distinct fingerprints: cut into
``max_bits + 1`` blocks, two linked ones agree in a whole block, so each block takes its turn
as leading bits.  In each turn fingerprints are sorted by Gray rank (range partitioned, so a
hot block value is spread), runs with one leading block are cut into index nodes of at most
``LEAF`` neighbours, each with the mask and pattern of the bits all its members share, and
again into nodes of ``SUB``.  Two nodes are compared only if the differences accumulated over
the bits both share stay within the limit, level by level.  A compared pair of nodes yields
spanning stars, never all of its links.

Defined results: null or empty text has fingerprint 0 and links like any other; equal texts
share a fingerprint and hence a component; null ids get a null component unless another
document of their component has an id; an empty table gives an empty result; other columns
of the input are dropped by ``near_duplicates`` and kept by ``first_of_group``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _text as X
from quarry.llm._graph import components
from quarry.llm._io import written
from quarry.llm._local import stars

LEAF, SUB = 256, 16
SEED = 42


def _fingerprint(words: list[bytes], k: int) -> int:
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 4096):
        part = words[at:min(at + 4096, n) + k - 1]
        grams = zip(*(part[j:] for j in range(k)), strict=False)
        h = np.array([digest(join(g), SEED) for g in grams], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """The 64 bits as a long (two's complement)."""
    @F.arrow_udf(T.LongType())
    def of(col: pa.Array) -> pa.Array:
        data, off = X.string_buffer(col)
        raw, out = data.tobytes(), np.zeros(len(col), np.uint64)
        for i in range(len(col)):
            out[i] = _fingerprint(raw[off[i]:off[i + 1]].lower().split(), shingle)
        return pa.array(out.view(np.int64))
    return of(text)


def _gray_rank(code: Column) -> Column:
    """Position of a code word in the reflected Gray sequence: prefix parities of its bits."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of max_bits + 1 blocks that cover 64 bits."""
    n = max_bits + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def _shared(fp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the bits all members agree on, pattern there) of the nodes beginning at ``first``."""
    ones = np.bitwise_and.reduceat(fp, first)
    any_one = np.bitwise_or.reduceat(fp, first)
    return ones | ~any_one, ones


_NODE = ("turn int, block long, node long, mask long, pattern long, fps array<long>, ids array<long>, "
         "a long, b long")


def _lists(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> list:
    return [values[i:j] for i, j in zip(first, last, strict=True)]


def _build(max_bits: int):
    """Sorted rows (turn, block, rank, fp, id) -> nodes that may meet others, and the stars of
    the links inside each node."""
    schema = pa.schema([("turn", pa.int32()), ("block", pa.int64()), ("node", pa.int64()),
                        ("mask", pa.int64()), ("pattern", pa.int64()), ("fps", pa.list_(pa.int64())),
                        ("ids", pa.list_(pa.int64())), ("a", pa.int64()), ("b", pa.int64())])

    def build(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            turn, block, rank, fp, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.ones(n, bool)
            new[1:] = (turn[1:] != turn[:-1]) | (block[1:] != block[:-1])
            bucket = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            at = np.arange(n) - begin[bucket]
            head = at % LEAF == 0
            leaf = np.cumsum(head) - 1
            first = np.flatnonzero(head)
            last = np.append(first[1:], n)
            bits = fp.view(np.uint64)
            found_a, found_b = [], []
            i = np.arange(n)
            for d in range(1, LEAF):
                i = i[i + d < last[leaf[i]]]
                if not len(i):
                    break
                hit = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= max_bits]
                found_a.append(hit)
                found_b.append(hit + d)
            a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
            b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
            node, root = stars(a, b, n)
            if len(node):
                none = pa.nulls(len(node))
                yield pa.RecordBatch.from_arrays(
                    [none.cast(f.type) for f in schema][:7] + [pa.array(ids[node]), pa.array(ids[root])],
                    schema=schema)
            # a block value with one node here meets none elsewhere, unless it touches the batch's ends
            per = np.bincount(bucket[first])
            keep = (per[bucket[first]] > 1) | (bucket[first] == 0) | (bucket[first] == bucket[-1])
            mask, pattern = _shared(bits, first)
            f, e = first[keep], last[keep]
            none = pa.nulls(len(f), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(turn[f]), pa.array(block[f]), pa.array(rank[f]),
                 pa.array(mask[keep].view(np.int64)), pa.array(pattern[keep].view(np.int64)),
                 pa.array(_lists(fp, f, e), pa.list_(pa.int64())), pa.array(_lists(ids, f, e), pa.list_(pa.int64())),
                 none, none], schema=schema)
    return build


def _compare(max_bits: int):
    """Pairs of nodes -> stars of the links between their members."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            out_a, out_b = [], []
            cols = [batch.column(i) for i in range(4)]
            for k in range(batch.num_rows):
                fa, ia, fb, ib = (np.asarray(c[k].values) for c in cols)
                fa, fb = fa.view(np.uint64), fb.view(np.uint64)
                sa, sb = np.arange(0, len(fa), SUB), np.arange(0, len(fb), SUB)
                ma, pa_ = _shared(fa, sa)
                mb, pb_ = _shared(fb, sb)
                near = np.bitwise_count((pa_[:, None] ^ pb_[None, :]) & ma[:, None] & mb[None, :]) <= max_bits
                x, y = [], []
                for i, j in zip(*np.nonzero(near), strict=True):
                    d = np.bitwise_count(fa[sa[i]:sa[i] + SUB, None] ^ fb[None, sb[j]:sb[j] + SUB])
                    p, q = np.nonzero(d <= max_bits)
                    x.append(p + sa[i])
                    y.append(q + sb[j] + len(fa))
                if not x:
                    continue
                node, root = stars(np.concatenate(x), np.concatenate(y), len(fa) + len(fb))
                ids = np.concatenate([ia, ib])
                out_a.append(ids[node])
                out_b.append(ids[root])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))],
                                                 schema=schema)
    return compare


def links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): spanning links among ``nodes`` (fp, id) with distinct fingerprints."""
    turns = None
    for t, (bit, width) in enumerate(_blocks(max_bits)):
        # the block [bit, bit + width) of the code becomes its leading bits
        code = _rotated(F.col("fp"), bit)
        one = nodes.select(F.lit(t).alias("turn"), F.shiftrightunsigned(code, 64 - width).alias("block"),
                           _gray_rank(code).alias("rank"), "fp", "id")
        turns = one if turns is None else turns.unionByName(one)
    ordered = turns.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    index = written(ordered.mapInArrow(_build(max_bits), _NODE), "simhash-index")
    inside = index.where("a is not null").select("a", "b")
    heads = index.where("a is null")
    x, y = heads.alias("x"), heads.alias("y")
    apart = F.bit_count(F.col("x.pattern").bitwiseXOR(F.col("y.pattern"))
                        .bitwiseAND(F.col("x.mask")).bitwiseAND(F.col("y.mask")))
    pairs = x.join(y, (F.col("x.turn") == F.col("y.turn")) & (F.col("x.block") == F.col("y.block"))
                   & (F.col("x.node") < F.col("y.node")) & (apart <= max_bits))
    across = (pairs.select(F.col("x.fps"), F.col("x.ids"), F.col("y.fps").alias("f"), F.col("y.ids").alias("i"))
              .mapInArrow(_compare(max_bits), "a long, b long"))
    return inside.unionByName(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id): the smallest id reachable over links."""
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")),
                     "simhash")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    group = components(links(distinct.where("first is not null").select("fp", F.col("first").alias("id")), max_bits),
                       name="simhash-components")
    members = (distinct.join(group, distinct["first"] == group["node"], "left")
               .select("fp", F.coalesce("component", "first").alias("component_id")))
    return prints.join(members, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"),
                                             "component_id")


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   max_bits: int = 3) -> DataFrame:
    """``docs`` without all but the smallest id of each component; rows that repeat that id,
    and rows without an id, stay."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
