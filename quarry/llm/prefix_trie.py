"""Conversation prefix trie: ternary search trees over range shards of turn sequences.

A turn is the md5 of its role and text, taken where the row is read, so no text moves; a conversation
is the row of its turns' 16-byte digests.  Conversations are range-partitioned by the digests of their
first ``KEY`` turns, then by id, so a shard holds neighbours and copies of one conversation spread over
as many shards as they need.  In a shard

1. the digests are encoded by the shard's sorted dictionary of turns;
2. the distinct sequences are inserted into a ternary search tree, medians first, so that the trees of
   siblings are balanced;
3. one iterative traversal, children before parents, accumulates members, smallest member, children,
   leaves and savings of every node.

Nodes on the paths of sequences that share their first ``KEY`` turns with the shard's first or last one
(the root always) may go on in other shards: only these boundary nodes are merged, by the md5 of their
path; their subtree sums come from pointer doubling over parents, a number of rounds logarithmic in the
depth.  All others are final in their shard.  The ids that end at a boundary node are hashed as a sorted
stream, so no list of members is held.

Defined results: null roles and texts are empty; turns are ordered by number (null first), ties by
digest; repeated rows are repeated turns; rows without a conversation id are left out; an id all of
whose turns are replaced by a shorter beginning still counts (turnless ones end at the root); an empty
table gives an empty result; further columns do not matter.  Digests of 128 bits stand for turns and paths.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._io import written

KEY = 16
SHARD_TURNS = 1 << 17
SIZE = 16
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ("boundary boolean, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, end_conv long")


def digest(role: Column, text: Column) -> Column:
    """md5 in hex of a turn; the role's length parts it from the text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """(conv_id, seq): the turns of every conversation in order, as (turn, digest, words) structs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), digest(F.col(role_col), F.col(text_col)).alias("digest"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return (turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("seq")))  # 16 bytes a turn, no text


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4, **columns) -> DataFrame:
    """``sequences`` with the first h turns of every conversation c replaced by those of c - c % group,
    h = crc32(decimal c) % most."""
    own = written(sequences(turns, **columns), "trie-sequences")
    c = F.col("conv_id")
    own = own.withColumn("h", (F.crc32(c.cast("string").cast("binary")) % most).cast("int")).withColumn("base", c - c % group)
    heads = own.select(c.alias("base"), F.slice("seq", 1, max(most - 1, 1)).alias("head"))
    joined = own.join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.expr("slice(seq, 1, 0)")), F.lit(1), F.col("h"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, rest).alias("seq"))


class _Tree:
    """A ternary search tree over integer sequences.  Tree nodes are rows of parallel lists: the branches
    ``low`` and ``high`` among siblings, ``down`` to the first child, the ``code`` and the depth."""

    def __init__(self) -> None:
        self.code, self.low, self.high, self.down, self.up, self.depth = [-1], [-1], [-1], [-1], [-1], [0]

    def _new(self, code: int, up: int) -> int:
        for column, value in ((self.code, code), (self.low, -1), (self.high, -1), (self.down, -1), (self.up, up),
                              (self.depth, self.depth[up] + 1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int]) -> int:
        """The node at the end of a sequence."""
        code, low, high, down = self.code, self.low, self.high, self.down
        at = 0
        for c in codes:
            node, last, side = down[at], at, down
            while node >= 0 and code[node] != c:
                last, side = node, (low if c < code[node] else high)
                node = side[node]
            if node < 0:
                node = side[last] = self._new(c, at)
            at = node
        return at


def _medians(n: int) -> list[int]:
    """0..n-1, the middle first, then the middles of both halves and so on."""
    out, level = [], [(0, n)]
    while level:
        below = []
        for a, b in level:
            if a < b:
                m = (a + b) // 2
                out.append(m)
                below += [(a, m), (m + 1, b)]
        level = below
    return out


def _shard(rows: list[tuple[int, bytes, list[int]]]):
    """Output rows of one shard of (conversation, digests, words)."""
    flat = np.frombuffer(b"".join(r[1] for r in rows), dtype="S16") if any(r[1] for r in rows) else np.zeros(0, "S16")
    # fixed-size bytes lose trailing zeros in numpy, which is the same for equal digests
    _, code = np.unique(flat, return_inverse=True)
    code, at, members, ending = code.tolist(), 0, {}, {}
    for conv, path, words in rows:
        n = len(path) // SIZE
        own = tuple(code[at:at + n])
        at += n
        members.setdefault(own, (path, words, []))[2].append(conv)
    order = sorted(members)
    tree = _Tree()
    words_of, path_of = {0: 0}, {0: (b"", 0)}
    for k in _medians(len(order)):
        own = order[k]
        path, words, convs = members[own]
        end = node = tree.insert(list(own))
        ending[end] = sorted(convs)
        while node not in path_of:
            d = tree.depth[node]
            words_of[node], path_of[node] = words[d - 1], (path, d)
            node = tree.up[node]
    n = len(tree.code)
    count, least, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    edge = [False] * n
    edge[0] = True
    keys = [r[1][:KEY * SIZE] for r in rows]
    ends = {min(keys), max(keys)}
    for node in ending:
        if members_key(path_of[node]) in ends:
            while not edge[node]:
                edge[node] = True
                node = tree.up[node]
    # children have larger numbers than their parents, so this order visits them first; what reaches a
    # boundary node from below is kept apart from what it adds itself
    for v in range(n - 1, -1, -1):
        own = ending.get(v, ())
        count[v] += len(own)
        if own and (least[v] is None or own[0] < least[v]):
            least[v] = own[0]
        if not edge[v]:
            leaves[v] += not children[v]
            saved[v] += (count[v] - 1) * words_of[v]
        u = tree.up[v]
        if u >= 0:
            count[u] += count[v]
            if least[u] is None or least[v] < least[u]:
                least[u] = least[v]
            if not edge[v]:
                children[u] += 1
                leaves[u] += leaves[v]
                saved[u] += saved[v]

    def key(v: int) -> bytes:
        path, d = path_of[v]
        return hashlib.md5(path[:d * SIZE]).digest()
    for v in range(n):
        u = tree.up[v]
        if edge[v]:
            yield (True, key(v), key(u) if u >= 0 else None, tree.depth[v], least[v], None, count[v], children[v], leaves[v],
                   saved[v], words_of[v], None, None)
            for conv in ending.get(v, ()):
                yield (True, key(v), None, tree.depth[v], None, None, 0, 0, 0, 0, words_of[v], None, conv)
        else:
            text = ",".join(map(str, ending.get(v, ())))
            yield (False, None, key(u) if edge[u] else None, tree.depth[v], least[v], None if edge[u] else least[u], count[v],
                   children[v], leaves[v], saved[v], words_of[v], hashlib.sha256(text.encode()).hexdigest(), None)


def members_key(path: tuple[bytes, int]) -> bytes:
    """What a sequence is routed by."""
    return path[0][:path[1] * SIZE][:KEY * SIZE]


def _tries(schema: pa.Schema):
    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        if not rows:
            return
        held = []
        for row in _shard(rows):
            held.append(row)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
                                                 schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)],
                                             schema=schema)
    return run


def _hash_ends(batches):
    """Sorted (key, conversation) rows -> (key, sha256 of the comma-joined ids), one id at a time."""
    last, state = None, None
    for batch in batches:
        done = []
        for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])],
                                             names=["key", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def _summed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, parent, leaves, saved) with both summed over subtrees, by pointer doubling: after
    round k a node holds the sums of its next 2 ** k levels and points 2 ** k levels up."""
    at = nodes.select("key", F.col("parent").alias("up"), "leaves", "saved")
    while True:
        at = written(at, "trie-sums")
        moving = at.where("up is not null")
        if moving.isEmpty():
            return at.select("key", "leaves", "saved")
        below = moving.groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = at.select(F.col("key").alias("up"), F.col("up").alias("next"))
        at = (at.join(jump, "up", "left").join(below, "key", "left")
              .select("key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                      (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))


def trie(convs: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``convs`` (conv_id, seq): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = convs.sparkSession
    path = F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), ""))
    rows = convs.select("conv_id", path.alias("path"), F.transform("seq", lambda t: t["words"]).alias("words"))
    rows = written(rows, "trie-rows")
    turns = rows.agg(F.sum(F.size("words") + 1).alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    dealt = rows.repartitionByRange(shards, F.substring("path", 1, KEY * SIZE), "conv_id")
    schema = spark.createDataFrame([], _NODE).schema
    found = written(dealt.mapInArrow(_tries(to_arrow_schema(schema)), _NODE), "trie-nodes")
    edge = found.where("boundary and end_conv is null")
    merged = edge.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"),
                                     F.first("depth").alias("depth"), F.first("words").alias("words"),
                                     F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
                                     F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    merged = written(merged, "trie-boundary")
    outer = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("outer"))
    merged = written(merged.join(outer, "key", "left").select(
        "key", "parent", "depth", "conv_id", "n_convs", (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("n_children"),
        "n_leaves", "saved", "words")
        .withColumn("leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
        .withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words")), "trie-merged")
    sums = _summed(merged.select("key", "parent", "leaves", "saved"))
    ends = found.where("end_conv is not null").select("key", "end_conv")
    ends = (ends.repartition("key").sortWithinPartitions("key", "end_conv")
            .mapInArrow(_hash_ends, "key binary, ends_sha256 string"))
    up = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    shared = (merged.drop("leaves", "saved").join(sums, "key").join(ends, "key", "left").join(up, "parent", "left")
              .select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children",
                      F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
    inner = (found.where("not boundary").join(up, "parent", "left")
             .select("conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), "n_convs", "n_children",
                     "n_leaves", "saved_tokens", "ends_sha256"))
    return shared.unionByName(inner)
