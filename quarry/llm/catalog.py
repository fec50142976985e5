"""Registered queries of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (collocations, decontaminate, embeddings, mixing, packing, paragraphs, pii, prefix_trie, quality,
                        secret_scan, simhash, suffixes, toxicity)
from quarry.llm._io import crc_mod, prepare, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    """The production quality model: labels outside the held-out fold (crc32 mod 5 = 0)."""
    labels = read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return quality.train(read(spark, sf_dir, "documents"), labels)


@register("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, sf_dir)).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                        "component_id")


@register("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")),
                        max_tokens=2048)


@register("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the items that leak into it and the share of the worst one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    per_doc = hits.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),  # bounded by the number of items
        F.max(F.col("covered") / F.col("words")).alias("coverage"))
    return (docs.select("doc_id").join(per_doc, "doc_id", "left")
            .select("doc_id", F.col("items").isNotNull().alias("contaminated"),
                    F.coalesce("items", F.array().cast("array<long>")).alias("items"),
                    F.coalesce("coverage", F.lit(0.0)).alias("coverage")))


@register("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: candidates, secrets, and the secrets' spans with their scores."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    bad = F.filter("findings", lambda c: c["secret"])
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(bad).cast("long").alias("n_secrets"),
        F.array_join(F.transform(bad, lambda c: F.concat_ws(":", c["start"], c["end"])), ",").alias("spans"),
        F.array_max(F.transform("findings", lambda c: c["score"])).alias("max_score"))


@register("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda c: c["base"])

    def written_out(spans):
        return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")

    def of(kind):
        return F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written_out(base), 256).alias("base_sha256"),
                        written_out(F.col("spans")).alias("spans"))


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "spans")


OP1_SQL = """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, r) AS (SELECT vec_id, vec_id FROM embeddings
                UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


@register("op1_embedding_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.9)


@register("op5_paragraph_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its paragraphs, those removed, and their bytes and places; those of fewer
    than 20 words are counted apart (``n_short...``) and stay."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = paragraphs.duplicates(docs)
    gone = F.when(F.col("removed"), F.struct("place", "start", "end", "cluster"))
    full = F.col("words") >= 20

    def counted(which, name):
        return F.count(F.when(which, 1)).alias(name)
    per_doc = found.groupBy("doc_id").agg(
        counted(full, "n_paragraphs"), counted(full & (F.col("size") > 1), "n_repeated"), counted(F.col("removed"), "n_removed"),
        counted(~full, "n_short"), counted(~full & (F.col("size") > 1), "n_short_repeated"),
        F.sum(F.when(F.col("removed"), F.col("end") - F.col("start")).otherwise(0)).alias("removed_bytes"),
        F.sort_array(F.collect_list(gone)).alias("removed"))  # a document's own paragraphs
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in
              ("n_paragraphs", "n_repeated", "n_removed", "n_short", "n_short_repeated", "removed_bytes")]
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", *counts, "removed")


@register("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.clean(docs, length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


OP11_SQL = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS place
       FROM d GROUP BY source),
s1 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
              source_size::DOUBLE * 2 AS most, 1 + (source_size + n_rows) // 65536 AS shards FROM s0),
s2 AS (SELECT *, coalesce(sum(source_size * 2) OVER o, 0)::DOUBLE AS held, sum(weight) OVER (ORDER BY most / weight, place
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER ()::DOUBLE AS total
       FROM s1 WINDOW o AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT arg_max((1.5::DOUBLE * total - held) / rest, rest)
               FILTER (WHERE NOT most < weight * ((1.5::DOUBLE * total - held) / rest)) AS unit FROM s2),
s AS (SELECT source, place, source_size, shards, CASE WHEN most < weight * unit THEN most ELSE weight * unit END AS target
      FROM s1, u),
g AS (SELECT d.*, place, source_size, target, substr(m, 9, 24) AS turn, ('0x' || substr(m, 1, 8))::BIGINT % shards AS shard
      FROM (SELECT *, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS m FROM d) d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT place, shard, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(source_size) AS source_size
      FROM g GROUP BY place, shard),
p2 AS (SELECT *, (words + 15) // 16 AS blocks, CASE WHEN words > 0 THEN target * words / source_size ELSE 0 END AS weight FROM p),
quotients AS (SELECT place, shard, weight / (2 * k + 1)::DOUBLE AS q, k FROM p2, unnest(range(2 * blocks)) AS r(k) WHERE weight > 0),
served AS (SELECT place, shard, count(*) AS quota FROM
  (SELECT * FROM quotients QUALIFY row_number() OVER (ORDER BY q DESC, place, shard, k)
     <= (SELECT round(1.5::DOUBLE * sum(words) / 16) FROM p)) GROUP BY place, shard),
q AS (SELECT p2.place, p2.shard, words, blocks, coalesce(quota, 0) // greatest(blocks, 1) AS whole,
             coalesce(quota, 0) % greatest(blocks, 1) AS extra,
             ('0x' || substr(md5('12:' || p2.place || ':' || p2.shard), 1, 8))::BIGINT % greatest(blocks, 1) AS first
      FROM p2 LEFT JOIN served USING (place, shard)),
e AS (SELECT place, shard, whole, first * words // greatest(blocks, 1) AS from1,
             least(first + extra, blocks) * words // greatest(blocks, 1) AS to1,
             greatest(first + extra - blocks, 0) * words // greatest(blocks, 1) AS to2 FROM q),
placed AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) - size AS x FROM g)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(least(x + size, to1) - greatest(x, from1), 0) + greatest(least(x + size, to2) - x, 0))::BIGINT AS taken
FROM placed JOIN e USING (place, shard)"""


@register("op11_source_mixing", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's words and target, and the words that the mix takes of it."""
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = """WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
parts AS (SELECT c.*, t.k, array_to_string(w[1:t.k], ' ') AS x, array_to_string(w[t.k + 1:], ' ') AS y
  FROM c JOIN (VALUES (1), (2), (3)) t(k) ON t.k < words),
cuts AS (SELECT p.lang, p.phrase, a, p.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.x JOIN f y ON y.lang = p.lang AND y.phrase = p.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM c, (VALUES (2), (3)) t(s), (VALUES (1), (2), (3)) u(i) WHERE s < words AND i + s - 1 <= words) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT QUALIFY rank <= 2000"""


@register("op12_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations.mine(read(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = """WITH t AS (SELECT conv_id, turn, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS pos FROM t),
ids AS (SELECT DISTINCT conv_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda a, i: xor(a >> 1, 3988292384::BIGINT * (a & 1))))) % 4 AS h
  FROM t),
r AS (SELECT ids.conv_id, 0 AS part, pos, dg, words FROM ids JOIN o ON o.conv_id = ids.conv_id - ids.conv_id % 20 AND pos <= h
      UNION ALL SELECT ids.conv_id, 1, pos, dg, words FROM ids JOIN o ON o.conv_id = ids.conv_id AND pos > h),
s AS (SELECT conv_id, words, row_number() OVER w AS depth, string_agg(dg, '') OVER w AS path FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, depth, path, words FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM m GROUP BY ALL),
parent AS (SELECT n.*, p.conv_id AS parent_conv_id, p.path AS up FROM n LEFT JOIN n p
           ON p.depth = n.depth - 1 AND p.path = substr(n.path, 1, 32 * (n.depth - 1))),
c AS (SELECT up AS path, count(*) AS n_children FROM parent WHERE depth > 0 GROUP BY up),
sums AS (SELECT m.path, sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM n LEFT JOIN c USING (path) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.path),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS e
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(e, '')) AS ends_sha256
FROM parent LEFT JOIN c USING (path) JOIN sums USING (path) LEFT JOIN ends USING (path)"""


@register("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.rebuilt(read(spark, sf_dir, "conversations")))
