"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import (decontaminate, embeddings, packing, paragraphs, pii, quality, secret_scan, simhash, suffixes,
                        toxicity)

N = 13


def labels(spark, name="quality"):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 1), (7, 0), (None, 1), (3, None), (99, 1), (7, 0)],
                                 f"doc_id long, {name} int")


def test_quality(spark, messy):
    model = quality.train(messy, labels(spark))
    out = quality.score(messy, model)
    assert out.count() == N and set(out.columns) == set(messy.columns)
    assert out.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.accepted(messy, model).columns == messy.columns
    by_text = out.groupBy("text").agg(F.countDistinct("score").alias("n")).where("n > 1")
    assert by_text.isEmpty()  # equal texts, equal scores
    empty = messy.limit(0)
    assert quality.score(empty, quality.train(empty, labels(spark))).isEmpty()
    one_class = quality.score(messy, quality.train(messy, labels(spark).where("quality = 1")))
    assert one_class.where("score != 0.5 or predicted != 1").isEmpty()


def test_toxicity(spark, messy):
    out = toxicity.score(messy, toxicity.train(messy, labels(spark, "toxic")))
    assert out.count() == N and out.where("score is null or score < 0 or score > 1").isEmpty()
    empty = messy.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, labels(spark, "toxic"))).isEmpty()


def test_pii(spark, messy):
    out = pii.find(messy)
    assert out.count() == N and "score" in out.columns and "text" not in out.columns
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in out.collect()}
    assert got[1] == [("email", 5, 21), ("phone", 30, 47)] == got[None] or got[None] == []
    assert got[2] == got[3] == got[6] == [] and got[9] == []
    assert pii.find(messy.limit(0)).isEmpty()
    plain = spark.createDataFrame([(1, "nothing here")], "doc_id long, text string")
    assert pii.find(plain).first()["spans"] == []


def test_many_matches_keep_their_offsets(spark):
    text = " ".join(f"p{i}@mail.example.com" for i in range(700))
    out = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert len(out) == 700 and all(text[s["start"]:s["end"]] == f"p{i}@mail.example.com" for i, s in enumerate(out))


def test_secrets(spark, messy):
    model = secret_scan.train(messy)
    out = secret_scan.scan(messy, model)
    assert out.count() == N and out.where("findings is null").isEmpty()
    red = secret_scan.redact(messy, model)
    assert red.columns == messy.columns and red.count() == N
    assert secret_scan.scan(messy.limit(0), secret_scan.train(messy.limit(0))).isEmpty()
    none = secret_scan.scan(messy, secret_scan.train(messy, findings=spark.createDataFrame(
        [], "value string, left string, right string, label int")))
    assert none.where(F.exists("findings", lambda f: f["secret"])).isEmpty()


def test_simhash(spark, messy):
    out = simhash.near_duplicates(messy)
    assert out.count() == N
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out.collect()]
    zero = {i for i, f, _ in rows if f == 0}
    assert zero == {2, 3, 6, None}  # null, empty and blank texts
    assert {c for i, f, c in rows if f == 0} == {2}
    assert {c for i, _, c in rows if i == 1} == {1}
    kept = simhash.first_of_group(messy)
    assert kept.columns == messy.columns and kept.where("doc_id = 1").count() == 2
    assert simhash.near_duplicates(messy.limit(0)).isEmpty()


def test_decontamination(spark, messy):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0.5), (2, None, 1.0),
                                   (3, "", 1.0), (4, "idiot", 1.0), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0.5)],
                                  "item_id long, text string, score double")
    out = decontaminate.scan(messy, items)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(7, 4)}
    assert decontaminate.clean(messy, items).columns[0] == "doc_id"
    assert decontaminate.clean(messy, items).count() == N - 1
    assert decontaminate.scan(messy.limit(0), items).isEmpty()
    assert decontaminate.clean(messy, items.limit(0)).count() == N


def test_reordered_passage_is_caught(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    moved = "x nine ten eleven twelve thirteen fourteen fifteen sixteen y z one two three four five six seven eight w"
    docs = spark.createDataFrame([(1, moved), (2, "one two three four five and nothing else")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = decontaminate.scan(docs, items).collect()
    assert [(r["doc_id"], r["covered"], len(r["tiles"])) for r in out] == [(1, 16, 2)]


def test_packing(spark, messy):
    import public_tokenizers
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(messy, path)
    per = out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in per} == {None, *range(1, 11)}
    assert out.where("doc_id = 2").first()["doc_tokens"] == 1
    assert packing.pack(messy.limit(0), path).isEmpty()


def test_paragraphs(spark, messy):
    line = " ".join(f"word{i}" for i in range(60))
    near = line.replace("word7 ", "other ")
    docs = spark.createDataFrame([(1, f"a\n{line}\nb", "x"), (2, f"{line}", "x"), (3, f"c\n{near}", None), (4, None, "x"),
                                  (2, f"{line}", "x")], "doc_id long, text string, place string")
    out = paragraphs.duplicates(docs).distinct()
    assert {(r["doc_id"], r["removed"], r["size"]) for r in out.collect()} == {(1, False, 3), (2, True, 3), (3, True, 3)}
    left = {(r["doc_id"], r["text"]) for r in paragraphs.remove(docs).collect()}
    assert left == {(1, f"a\n{line}\nb"), (2, ""), (3, "c"), (4, None)}
    assert paragraphs.duplicates(messy).count() >= 2
    assert paragraphs.duplicates(messy.limit(0)).isEmpty()


def test_suffixes(spark, messy):
    out = suffixes.clean(messy).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert len(out) == N
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert got[2]["n_bytes"] == got[3]["n_bytes"] == 0 and got[1]["n_removed"] == 0
    assert got[4]["n_removed"] == got[4]["n_bytes"] and got[5]["n_spans"] == 1
    assert got[9]["n_removed"] == 30_000 and bytes(got[9]["kept"]) == b""
    assert got[8]["n_removed"] == 2000 and bytes(got[8]["kept"]) == b"\n"
    assert suffixes.clean(messy.limit(0)).isEmpty()


def test_embeddings(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(1, v), (2, v), (3, [0.99, 0.1, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]),
            (8, [float("nan"), 0.0, 1.0]), (9, [None, 1.0, 0.0]), (10, [1.0, 0.0]), (11, [2.0, 0.0, 0.0]), (1, v),
            (None, v), (12, [float("inf"), 0.0, 0.0]), (13, [1e-30, 0.0, 0.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, component_id string")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(docs).collect()}
    assert out[1] == (6, 1, True) and out[2] == (6, 1, False) and out[3] == (6, 1, False) and out[13][1] == 1
    assert all(out[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12))
    assert out[None][1:] == (None, None)
    assert embeddings.near_duplicates(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, messy, stage):
    import corpus_pipeline
    from tests.conftest import SF_SMALL
    name, fn = corpus_pipeline.STAGES[stage]
    for docs in (messy, messy.limit(0)):
        out = fn(spark, docs, SF_SMALL)
        n = out.count()
        if stage < 4:
            assert out.columns == docs.columns
            assert out.where("score != 1.5 or component_id != 'c'").isEmpty()
        assert docs.isEmpty() == (n == 0)
