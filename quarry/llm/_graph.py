"""Connected components of an edge table by alternating large-star and small-star rounds.

Only shuffles by node with map-side combined minima and sort-merge joins, so a node with a
third of all edges is split by adaptive skew handling; nothing is collected but one count per
round.  Rounds needed grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._io import written

MAX_ROUNDS = 60


def _smaller(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour below u, for nodes that have one.  ``edges`` hold hi > lo."""
    return edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest node.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows."""
    e = (edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    e = written(e, name)
    for _ in range(MAX_ROUNDS):
        # large star: of an edge (hi, lo), hi moves to the smallest neighbour of lo (or lo itself)
        m = _smaller(e)
        large = (e.join(m, e["lo"] == m["u"], "left")
                 .select("hi", F.coalesce("m", "lo").alias("lo")))
        # hi's other side: lo is linked to hi's smallest neighbour by the small star
        pairs = large.distinct()
        m2 = _smaller(pairs)
        small = (pairs.join(m2, pairs["hi"] == m2["u"])
                 .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                         F.col("m").alias("lo")))
        nxt = written(small.distinct(), name)
        # settled when every node points at one smaller node that points nowhere
        left = nxt.join(nxt.select(F.col("hi").alias("u")).distinct(), F.col("lo") == F.col("u"), "left_semi")
        many = nxt.groupBy("hi").count().where("count > 1")
        e = nxt
        if left.isEmpty() and many.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
