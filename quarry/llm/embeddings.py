"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale each; the length of each vector's residue is
measured, so a product of codes bounds the true cosine from both sides:
|x.y - sx sy (qx.qy)| <= ex + ey + ex ey.  Code products of whole tiles are exact in float32
matrix products (slices of at most 1024 dimensions keep sums below 2^24).  Pairs surely below the threshold are
dropped, surely above it accepted, and only the others are computed in double precision.

Equal vectors are first merged, with their number.  Each vector goes to the cell of its nearest
pivot (a bounded sample of vectors), and a cell is cut into blocks of about ``block`` vectors, each
one row, so a hot cell makes many tiles and no task holds more than two blocks in Python.  Two blocks
are compared only if each one's smallest angle to the other's pivot is at most the other's radius
and the threshold's angle together, which never loses a link.  Tasks read the written blocks of two
files and compare them where they are read: no tile is shuffled or written, so disk grows with the
vectors, not with their pairs.  A task yields link counts and spanning stars of all its tiles, never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components have
no links and are their own component (kept); vectors of different length do not link; repeated
rows are vectors of their own that link with one another; null ids take part in no component
(theirs is null, ``kept`` too) but are counted as links; an empty table gives an empty result;
other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._graph import components
from quarry.llm._io import written
from quarry.llm._local import stars

SLICE = 1024
SLACK = 1e-9


def _rows(col: pa.Array) -> list[np.ndarray]:
    """Vectors of a list<float> column as float64."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = np.asarray(col.flatten(), dtype=np.float64)
    edge = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))]).astype(np.int64)
    return [values[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, lengths of the residues) of unit rows."""
    scale = np.abs(u).max(axis=1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    residue = u - scale[:, None] * codes
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", residue, residue)) * (1 + SLACK) + SLACK


def linked(ua: np.ndarray, ub: np.ndarray, threshold: float, coded=None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of unit rows with a cosine of at least ``threshold``; ``coded``: both quantised."""
    (qa, sa, ea), (qb, sb, eb) = coded or (quantise(ua), quantise(ub))
    dot = np.zeros((len(ua), len(ub)), np.float64 if ua.shape[1] > SLICE else np.float32)
    for d in range(0, ua.shape[1], SLICE):
        dot += qa[:, d:d + SLICE].astype(np.float32) @ qb[:, d:d + SLICE].astype(np.float32).T
    # screen: a row's least product that the bounds allow to reach the threshold, in the precision of
    # the products with their rounding on the safe side
    screen = dot
    screen *= sb.astype(dot.dtype)[None, :]
    least = (threshold - ea - eb.max() * (1 + ea)) / sa - 1e-5 * np.abs(threshold / sa)
    p, q = np.nonzero(screen >= least.astype(dot.dtype)[:, None])
    good = np.zeros(len(p), bool)
    for k in range(0, len(p), 1 << 16):
        i, j = p[k:k + (1 << 16)], q[k:k + (1 << 16)]
        # the same products once more, exactly, for their bounds in double precision
        near = np.einsum("ij,ij->i", qa[i], qb[j], dtype=np.int64) * sa[i] * sb[j]
        bound = ea[i] + eb[j] + ea[i] * eb[j]
        sure = near - bound >= threshold
        open_ = np.flatnonzero(~sure & (near + bound >= threshold))
        sure[open_] = np.einsum("ij,ij->i", ua[i[open_]], ub[j[open_]]) >= threshold
        good[k:k + (1 << 16)] = sure
    return p[good], q[good]


def _distinct(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(embedding, id, n): the usable vectors, equal ones merged under their smallest id."""
    v = F.col("embedding")
    usable = (v.isNotNull() & (F.size(v) > 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(v, lambda x: x != 0))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")).where(usable)
            .groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))


def _digest(vec_col):
    """128 bits of a vector's numbers (-0.0 as 0.0), which stand for it where only equality counts."""
    return F.unhex(F.md5(F.transform(vec_col, lambda x: x + F.lit(0.0)).cast("string")))


def _assigner(pivots: dict[int, np.ndarray]):
    """Rows (embedding, id, n) -> with length and cell (-1: no pivot of this length)."""
    def run(batches):
        for batch in batches:
            rows = _rows(batch.column(0))
            size = np.array([len(r) for r in rows], np.int64)
            cell = np.full(len(rows), -1, np.int64)
            for d in np.unique(size):
                if int(d) in pivots:
                    at = np.flatnonzero(size == d)
                    cell[at] = (unit(np.array([rows[i] for i in at])) @ pivots[int(d)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(size), pa.array(cell)],
                                             names=["embedding", "id", "n", "size", "cell"])
    return run


BLOCK = "i long, size long, cell long, radius double, near array<float>, ids binary, valid binary, n binary, vectors binary"


def _packer(pivots: dict[int, np.ndarray]):
    """Rows (i, size, cell, members) -> ``BLOCK``: the members as plain numbers, their largest angle to the
    cell's pivot and their smallest to every pivot."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, size, cell = (batch.column(c)[k].as_py() for c in range(3))
                m = batch.column(3)[k].values
                ids = m.field("id")
                x = np.asarray(m.field("embedding").flatten()).reshape(len(m), size)
                x = x if x.dtype == np.float32 else x.astype(np.float64)
                radius, near = np.pi, []
                if cell >= 0:
                    cos = np.clip(unit(x.astype(np.float64)) @ pivots[size].T, -1, 1)
                    radius, near = float(np.arccos(cos[:, cell].min())), np.arccos(cos.max(axis=0)).tolist()
                blobs = [np.asarray(ids.fill_null(-1)).tobytes(), np.asarray(ids.is_valid()).tobytes(),
                         np.asarray(m.field("n")).tobytes(), x.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([size]), pa.array([cell]), pa.array([radius]), pa.array([near], pa.list_(pa.float32())),
                     *[pa.array([v], pa.binary()) for v in blobs]],
                    names=["i", "size", "cell", "radius", "near", "ids", "valid", "n", "vectors"])
    return run


EDGES = 1 << 20  # links that a task keeps before it makes them spanning stars


def _tiles(threshold: float, dtype):
    """Rows (size, and i, ids, valid, n, vectors of either block) -> (id, links) and (a, b) stars of all tiles
    of the task."""
    def run(batches):
        first, ids, valid, links, total = {}, [], [], [], 0  # of the blocks met, some of two files
        left, edges = (None,), np.empty((2, 0), np.int64)

        def met(batch, k, c):
            nonlocal total
            i = batch.column(c)[k].as_py()
            if i not in first:
                first[i] = (total, len(ids))
                ids.append(np.frombuffer(batch.column(c + 1)[k].as_py(), np.int64))
                valid.append(np.frombuffer(batch.column(c + 2)[k].as_py(), bool))
                links.append(np.zeros(len(ids[-1]), np.int64))
                total += len(ids[-1])
            u = unit(np.frombuffer(batch.column(c + 4)[k].as_buffer(), dtype).reshape(-1, batch.column(0)[k].as_py()).astype(np.float64))
            return i, np.frombuffer(batch.column(c + 3)[k].as_py(), np.int64), u, quantise(u)

        for batch in batches:
            for k in range(batch.num_rows):
                if left[0] != batch.column(1)[k].as_py():
                    left = met(batch, k, 1)
                (i, na, ua, ca), (j, nb, ub, cb) = left, left if left[0] == batch.column(6)[k].as_py() else met(batch, k, 6)
                p, q = linked(ua, ub, threshold, (ca, cb))
                (at, a), (bt, b) = first[i], first[j]
                if i == j:
                    p, q = p[p != q], q[p != q]  # no vector with itself
                else:
                    np.add.at(links[b], q, na[p])
                np.add.at(links[a], p, nb[q])
                both = valid[a][p] & valid[b][q]  # null ids link no others
                edges = np.concatenate([edges, [at + p[both], bt + q[both]]], axis=1)
                if edges.shape[1] > max(EDGES, 2 * total):
                    edges = np.array(stars(*edges, total))
        for i, ok, n in zip(ids, valid, links, strict=True):
            hit = (n > 0) & ok
            if hit.any():
                yield _batch(i[hit], n[hit], None, None)
        if edges.shape[1]:
            every = np.concatenate(ids)
            node, root = stars(*edges, total)
            for k in range(0, len(node), EDGES):
                yield _batch(None, None, every[node[k:k + EDGES]], every[root[k:k + EDGES]])
    return run


def _batch(ids, links, a, b):
    n = len(ids) if ids is not None else len(a)
    cols = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (ids, links, a, b)]
    return pa.RecordBatch.from_arrays(cols, names=["id", "links", "a", "b"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                    block: int = 2048, max_pivots: int = 4096, pivot_values: int = 1 << 22) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``; ids are longs.

    ``max_pivots`` and ``pivot_values`` (numbers in all pivots) bound the sample sent to tasks."""
    spark = vectors.sparkSession
    ids = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("embedding"))
    distinct = written(_distinct(ids, "id", "embedding"), "vectors")
    total, widest = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    k = max(1, min(max_pivots, pivot_values // widest, total // block))
    sample = [np.array(r["embedding"], dtype=np.float64) for r in
              distinct.orderBy(F.xxhash64("embedding"), "id").limit(k).select("embedding").collect()]
    pivots = {d: unit(np.array([s for s in sample if len(s) == d])) for d in {len(s) for s in sample}}
    kind = dict(distinct.dtypes)["embedding"]
    placed = distinct.select("embedding", "id", "n").mapInArrow(
        _assigner(pivots), f"embedding {kind}, id long, n long, size long, cell long")
    # every pivot has a cell, whatever the count: at most max_pivots, and one for each length without a pivot
    cells = {(d, c): 0 for d, p in pivots.items() for c in range(len(p))}
    cells.update({(r["size"], r["cell"]): r["count"] for r in placed.groupBy("size", "cell").count().collect()})
    ranges, first = [], 0
    for (size, cell), count in sorted(cells.items()):
        ranges.append((size, cell, first, max(1, -(-count // block))))
        first += ranges[-1][3]
    plan = spark.createDataFrame(ranges, "size long, cell long, first long, blocks long")
    numbered = (placed.join(F.broadcast(plan), ["size", "cell"])  # a row a cell
                .withColumn("i", F.col("first") + F.pmod(F.xxhash64("embedding", "id"), F.col("blocks"))))
    packed = numbered.groupBy("i", "size", "cell").agg(F.collect_list(F.struct("id", "n", "embedding")).alias("members"))
    packed = written(packed.select("i", "size", "cell", "members").mapInArrow(_packer(pivots), BLOCK),
                     "vector-blocks")  # about ``block`` vectors a row
    found = written(block_pairs(packed, threshold).mapInArrow(
        _tiles(threshold, np.float32 if kind == "array<float>" else np.float64), "id long, links long, a long, b long"), "vector-links")
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.where("a is not null").select("a", "b"), name="vector-components")
    known = (distinct.select("id", "n", _digest("embedding").alias("vector"))
             .join(links, "id", "left").join(group, F.col("id") == group["node"], "left")
             .select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "id").alias("component_id")))
    out = (ids.select("id", _digest("embedding").alias("vector")).join(known, "vector", "left")
           .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                   F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def block_pairs(packed: DataFrame, threshold: float) -> DataFrame:
    """Rows of two blocks that may hold links, each pair once.  A nested loop over the files of ``packed`` on both
    sides, so that nothing is moved; which of two blocks comes first changes with their numbers, which evens out tasks."""
    x, y = (packed.select(*[F.col(c).alias(f"{c}_{s}") for c in packed.columns]) for s in "xy")
    i, j = F.col("i_x"), F.col("i_y")
    reach = float(np.arccos(threshold)) + 1e-6

    def near(a, b):  # null: no pivot
        return F.coalesce(F.get(f"near_{b}", F.col(f"cell_{a}").cast("int")) <= F.col(f"radius_{a}") + F.lit(reach), F.lit(True))
    one_way = (i == j) | ((i != j) & ((i < j) == ((i + j) % 2 == 0)))
    alike = (F.col("size_x") <= F.col("size_y")) & (F.col("size_x") >= F.col("size_y"))  # an equation would be a key to shuffle by
    return (x.join(y.hint("shuffle_replicate_nl"), one_way & alike & near("x", "y") & near("y", "x"))
            .select("size_x", *[f"{c}_{s}" for s in "xy" for c in ("i", "ids", "valid", "n", "vectors")]))
