"""The forest decides: labelled examples held out by form, harmless lines that must stay, one search a text."""

from pyspark.sql import functions as F

from quarry.llm import secret_examples, secret_scan
from quarry.llm._spans import MARK, with_matches

HARMLESS = [
    "max_tokens=2048", "tokens: 4096", "token_count: 15000", "author:Smith", "author: J.Smith", "authors=Doe-Jane", "secretary: M.Jones",
    "authority: www.example.org", "authored_on: 2021-05-04", "auth_type=oauth2", "tokenizer=bert-base-uncased", "api_key=YOUR_API_KEY",
    "password: ********", "password = input()", "token = null", "secret=${SECRET}", "password: changeme", "authentic=Chianti2019riserva",
    "the secret of eternal youth", "token = get_token(user)", "passwords: several", "tokenId: 17", "password_hash_rounds=12", "keyboard: qwerty-layout",
    "monkey: business", "turkey=roasted", "access_keys: none", "password = getpass.getpass()", "secrets.json", "tokens_per_second: 42.5"]


def test_harmless_lines_stay(spark):
    docs = spark.createDataFrame(list(enumerate(HARMLESS)), "doc_id long, text string")
    model = secret_scan.train(docs)
    assert [r["text"] for r in secret_scan.redact(docs, model).orderBy("doc_id").collect()] == HARMLESS


def test_held_out_examples(spark):
    """Half of the forms are learnt from, the other half is judged."""
    rows = secret_scan.labelled(spark)
    forms = rows.select("example").distinct().count()
    assert forms >= 150 and abs(rows.where("label = 1").count() / rows.count() - 0.5) < 0.1
    held = F.crc32(F.concat(F.lit("form "), F.col("example").cast("string")).cast("binary")) % 2 == 0
    model = secret_scan.train(None, rows.where(~held), words=secret_examples.WORDS)
    out = secret_scan.judge(rows.where(held), model).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("found")).collect()
    n = {r["label"]: (r["found"], r["n"]) for r in out}
    precision, recall = n[1][0] / (n[1][0] + n[0][0]), n[1][0] / n[1][1]
    print("precision", precision, "recall", recall, n)
    assert precision >= 0.88 and recall >= 0.88


def test_forest_alone_decides(spark):
    docs = spark.createDataFrame([(1, "token = \"0123456789abcdef0123456789abcdef01234567\""), (2, "commit 0123456789abcdef0123456789abcdef01234567")],
                                 "doc_id long, text string")
    turned = secret_scan.labelled(spark).withColumn("label", 1 - F.col("label"))
    for findings, secret in ((None, [True, False]), (turned, [False, True])):
        out = secret_scan.scan(docs, secret_scan.train(docs, findings)).orderBy("doc_id").collect()
        assert [r["findings"][0]["secret"] for r in out] == secret


def test_one_search_finds_what_two_find(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in tables("documents")] + [
        (-1, f"a{MARK}b password=abc12345 {MARK}"), (-2, None), (-3, ""), (-4, "password=abc12345"), (-5, "x password=abc12345 y token=zz99zz99 z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    both = with_matches(with_matches(docs, "once", text, secret_scan.CANDIDATE, searched_once=True), "twice", text, secret_scan.CANDIDATE)
    assert both.where("once != twice").isEmpty() and both.where("size(twice) > 0").count() > 3
