"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's documents are dealt by a seeded hash to shards of about ``shard_words`` words and
stand there in seeded order; a shard's run of words is cut into equal blocks of about ``block``
words.  A source's target is shared out to its shards by their words, and all blocks of the mix
are allocated to the shards by highest quotients target / (2 k + 1), no shard getting more than
``repeat`` times its blocks.  The quotient that parts the served from the others is found by
sections over a table of shards (one aggregate a round, a few numbers to the driver), the last
blocks by rank, so no seat is dealt one by one.  A quota of q blocks over n is q // n whole passes
and one seeded cyclic run of q % n blocks, so all but the documents at the run's two ends stay
whole.  Everything is built-in functions; after the scan only (id, source, size, mark) rows move,
equal rows as one with their number.

Targets: the sources in order of their code points (null last) weigh ``weights`` in turn and share
``share`` times all words; a target stops at ``repeat`` times its source's words and the excess is
shared again by weight until none is above.

Defined results: words are runs of other characters than blank and tab to carriage return; null and
empty texts have size 0 and take 0; a null source is a source of its own, the last; null ids are
ordinary values; equal rows take their own parts of the run; sources without words have target 0;
an empty table gives an empty result; further columns do not matter.  Equal quotients go by source,
then shard.  The result is a function of the rows, whatever their order or partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._io import written
from quarry.plans.ordering import global_rank

WORD = r"[^\x20\x09-\x0D]+"
SECTIONS = 32
#: sources up to this number are sent to the tasks (some 50 bytes each), more are joined by shuffle
SOURCES_SENT = 50_000


def hashed(seed: int, *cols: Column) -> Column:
    """md5 in hex of a seed and some columns, nulls as empty."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def number(hexed: Column, modulus: Column) -> Column:
    """The first eight hex digits modulo a positive number."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long") % modulus


def _half_up(weight: Column, divisor: float, cap: Column) -> Column:
    return F.least(cap, F.floor(weight / F.lit(divisor) + F.lit(0.5)).cast("long"))


def apportion(parties: DataFrame, seats: int, weight: str, cap: str, order: list[Column], name: str = "quota") -> DataFrame:
    """``parties`` (a stable table) with integer quotas that sum to ``seats``, given by highest quotients
    weight / (2 k + 1), ``cap`` at most to each; equal quotients go by ``order``.  If the caps do not
    hold so many seats all are full."""
    w, c = F.col(weight), F.col(cap)
    total = parties.agg(F.sum(w).alias("w"), F.sum(F.when(w > 0, c)).alias("c")).first()
    seats = min(seats, total["c"] or 0)
    if seats <= 0:
        return parties.withColumn(name, F.lit(0).cast("long"))
    if seats == total["c"]:
        return parties.withColumn(name, F.when(w > 0, c).otherwise(0).cast("long"))

    def served(divisors: list[float], low: float, high: float):
        at = parties.select(w.alias("w"), c.alias("c"), F.posexplode(F.lit([*divisors, low, high])).alias("k", "d"))
        k = len(divisors)
        seats_at = F.least("c", F.floor(F.col("w") / F.col("d") + F.lit(0.5)).cast("long"))
        sums = {r["k"]: r["s"] for r in at.groupBy("k").agg(F.sum(seats_at).alias("s")).collect()}
        apart = parties.agg(F.max(_half_up(w, low, c) - _half_up(w, high, c)).alias("apart")).first()["apart"]
        return [sums[i] for i in range(k)], apart

    # high serves at most ``seats``, low at least as many
    low, high = total["w"] / seats / 2, total["w"] / seats * 2
    under, over, apart = None, None, 2
    while apart > 1 or under is None or over is None:
        step = (high / low) ** (1 / SECTIONS)
        points = [low * step ** k for k in range(SECTIONS)] + [high]
        sums, apart = served(points, low, high)
        if sums[0] < seats:
            high, low = low, low / 16
            continue
        if sums[-1] > seats:
            low, high = high, high * 16
            continue
        under, over = sums[-1], sums[0]
        if apart <= 1:
            break
        k = max(i for i, s in enumerate(sums) if s >= seats)
        if k == SECTIONS:
            under, low, high = seats, points[k], points[k]
            break
        if (points[k], points[k + 1]) == (low, high):
            break
        low, high, over, under = points[k], points[k + 1], sums[k], sums[k + 1]
    first = _half_up(w, high, c)
    if under == seats:
        return parties.withColumn(name, first)
    at_edge = parties.withColumn("__first", first).withColumn("__most", _half_up(w, low, c))
    open_ = (at_edge.where(F.col("__most") > F.col("__first"))
             .select("*", F.explode(F.sequence("__first", F.col("__most") - 1)).alias("__k"))
             .withColumn("__quotient", w / (2 * F.col("__k") + 1).cast("double")))
    ranked = global_rank(open_, [F.desc("__quotient"), *order, F.asc("__k")], rank_col="__rank")
    keys = parties.columns
    more = (ranked.where(F.col("__rank") <= seats - under)
            .groupBy(*[F.col(x).alias(f"__{x}") for x in keys]).agg(F.count(F.lit(1)).alias("__more")))
    same = reduce(and_, [F.col(x).eqNullSafe(F.col(f"__{x}")) for x in keys])
    return (parties.join(more, same, "left")
            .select(*keys, (first + F.coalesce("__more", F.lit(0))).alias(name)))


def targets(sources: DataFrame, weights: tuple, share: float, repeat: int) -> DataFrame:
    """``sources`` (source, source_size, rows, place) with ``target``."""
    weight = F.lit(float(weights[-1]))
    for k, v in reversed(list(enumerate(weights[:-1]))):
        weight = F.when((F.col("place") - 1) % len(weights) == k, float(v)).otherwise(weight)
    sources = sources.withColumn("weight", weight)
    most = F.col("source_size").cast("double") * float(repeat)
    unit, full = 0.0, -1
    while True:  # every round fills more sources, so it ends; most often within a few
        above = (most < F.col("weight") * F.lit(unit)) if full >= 0 else F.lit(False)
        row = sources.agg(F.sum("source_size").alias("all"), F.count(F.when(above, 1)).alias("full"),
                          F.sum(F.when(above, F.col("source_size") * repeat).otherwise(0)).alias("held"),
                          F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if row["full"] == full or not row["rest"]:
            break
        full, unit = row["full"], (share * float(row["all"]) - float(row["held"])) / row["rest"]
    target = F.when(most < F.col("weight") * F.lit(unit), most).otherwise(F.col("weight") * F.lit(unit))
    return sources.withColumn("target", target)


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))
            .groupBy("id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("copies")))


def _with_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    side = F.broadcast(sources) if n <= SOURCES_SENT else sources
    return rows.join(side.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = (3, 1, 2), share: float = 1.5, repeat: int = 2, block: int = 16, shard_words: int = 1 << 16,
        seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: id, source, mark (the text's hash), size, source_size, target (its
    source's), taken, and ``pieces``: the runs of words (start, end, times) that the mix takes of it."""
    groups = written(_groups(docs, id_col, text_col, source_col), "mix-sizes")
    per_source = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                              F.sum("copies").alias("rows"))
    ranked = written(global_rank(per_source, [F.col("source").asc_nulls_last()], rank_col="place"), "mix-sources")
    n = ranked.count()
    shards = F.expr(f"1 + (source_size + rows) div {shard_words}")
    sources = written(targets(ranked, weights, share, repeat).withColumn("shards", shards), "mix-targets")
    dealt = _with_sources(groups, sources.select("source", "place", "shards"), n)
    order = hashed(seed, F.col("id"))
    dealt = dealt.select("id", "source", "size", "mark", "copies", "place", F.substring(order, 9, 24).alias("turn"),
                         number(order, F.col("shards")).alias("shard"))
    parts = dealt.groupBy("source", "place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    parts = _with_sources(parts, sources.select("source", "source_size", "target"), n)
    parts = written(parts.select("place", "shard", "words", "source_size", "target",
                                 F.expr(f"(words + {block - 1}) div {block}").alias("blocks"))
                    .withColumn("weight", F.when(F.col("words") > 0, F.col("target") * F.col("words") / F.col("source_size"))
                                .otherwise(0.0))
                    .withColumn("most", F.col("blocks") * repeat), "mix-shards")
    seats = parts.agg(F.round(F.lit(share) * F.sum("words").cast("double") / block).cast("long").alias("n")).first()["n"]
    quotas = apportion(parts, seats or 0, "weight", "most", [F.asc("place"), F.asc("shard")])
    start = F.when(F.col("blocks") > 0, number(hashed(seed + 1, F.col("place"), F.col("shard")), F.greatest(F.col("blocks"), F.lit(1))))

    def edge(j: Column) -> Column:  # the first word of block j
        return F.when(F.col("blocks") > 0, F.floor(j * F.col("words") / F.col("blocks")).cast("long")).otherwise(0)
    whole = F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0)
    quotas = (quotas.withColumn("whole", whole).withColumn("first", F.coalesce(start, F.lit(0)))
              .withColumn("end", F.col("first") + F.col("quota") - F.col("whole") * F.col("blocks")))
    quotas = quotas.select("place", "shard", "source_size", "target", "whole", edge(F.col("first")).alias("from1"),
                           edge(F.least("end", "blocks")).alias("to1"),
                           edge(F.greatest(F.col("end") - F.col("blocks"), F.lit(0))).alias("to2"))
    w = Window.partitionBy("place", "shard").orderBy("turn", "id", "size", "mark")
    run = F.col("size") * F.col("copies")
    placed = dealt.withColumn("at", F.sum(run).over(w) - run)
    # equal rows, one after another; in two steps, so that no long array is held
    placed = (placed.join(quotas, ["place", "shard"])
              .select("*", F.explode(F.expr("sequence(0L, (copies - 1) div 1024)")).alias("thousand"))
              .select("*", F.explode(F.expr("sequence(thousand * 1024, least(copies, (thousand + 1) * 1024) - 1)")).alias("copy"))
              .withColumn("x", F.col("at") + F.col("copy") * F.col("size")).withColumn("y", F.col("x") + F.col("size")))
    zero = F.lit(0).cast("long")

    def piece(a: Column, b: Column, times: Column) -> Column:
        return F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), times.cast("long").alias("times"))
    x, y = F.col("x"), F.col("y")
    pieces = F.array(piece(zero, F.col("size"), F.col("whole")),
                     piece(F.greatest(x, "from1") - x, F.least(y, "to1") - x, F.lit(1)),
                     piece(zero, F.least(y, "to2") - x, F.lit(1)))
    pieces = F.filter(pieces, lambda p: (p["end"] > p["start"]) & (p["times"] > 0))
    taken = F.aggregate("pieces", zero, lambda s, p: s + (p["end"] - p["start"]) * p["times"])
    return (placed.withColumn("pieces", pieces)
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "mark", "size", "source_size", "target",
                    taken.alias("taken"), "pieces"))


def texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The mix itself: (id, source, start, end, text) with one row per taken run and time, its words
    joined by blanks; ``mixed`` is what ``mix`` returned for ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.xxhash64(text).alias("__mark"),
                      text.alias("__text")).dropDuplicates(["__id", "__source", "__mark"])
    runs = mixed.select(id_col, source_col, "mark", F.explode("pieces").alias("p"))
    both = runs.join(one, runs[id_col].eqNullSafe(one["__id"]) & runs[source_col].eqNullSafe(one["__source"])
                     & (runs["mark"] == one["__mark"]))
    words = F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))
    cut = F.slice(words, (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int"))
    return (both.select(id_col, source_col, F.col("p.start").alias("start"), F.col("p.end").alias("end"),
                        F.array_join(cut, " ").alias(text_col),
                        F.explode(F.sequence(F.lit(1), F.col("p.times").cast("int"))).alias("time")).drop("time"))
