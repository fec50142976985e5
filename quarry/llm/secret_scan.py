"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are, in this order: values of four characters or more that a credential name and a
separator introduce (``password=...``, ``"api_key": "..."``, ``?token=...``), with or without
digits, up to the closing quote or the end of the word; credentials after ``Bearer`` or
``Basic``; passwords of URLs (``://user:...@``); keys of well-known formats (``FORMATS``); and
runs of at least 16 characters of ``[A-Za-z0-9+/_-]`` with a digit.  A name introduces by its last part only
(``db_password``, ``authToken``, not ``token_count``, ``tokens`` or ``author``), and a word that a
bracket follows is a call, not a value.  An equals sign belongs to a
run only as its padding, so a name never joins its value.  Features: length, character
transitions, distinct characters, share covered by dictionary words (the corpus's most frequent
words, counted over all documents, and some general ones), path signs, marks of placeholders, the words
beside the candidate and its format.
The forest (built-in ML, DataFrame API) is trained on labelled findings, the caller's or those of
``secret_examples``, and alone decides which candidates are secrets.  Its trees become column expressions, so
the scan is one search of every text by built-in functions without a shuffle.

Defined results: null or empty text has no candidates; repeated documents give equal results;
null ids are ordinary values; if the labelled findings are of one class (or none) that class
(none: no secret) is the answer for every candidate; an empty table gives an empty result;
other columns pass through unless they bear a result's name (``findings``), which is replaced.
Findings are in text order and never overlap.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import secret_examples
from quarry.llm._spans import with_matches

# words of which a credential's name is made, and names of harmless values
_CREDENTIAL = ("(?i:token|(?:client|access|api|private|secret|auth)[_-]?key|secret|passw(?:or)?d|passwd|pwd|passphrase|"
               "auth(?:orization)?|credentials?)")
_HARMLESS = "(?i)(?:sha-?[0-9]*|md5|commit|checksum|hash|digest|uuid|guid|version|isbn|example|sample|test|dummy|etag|integrity|nonce|base64)"
# a name's last part: it begins the name, follows a sign or digit or is a turn of case, and nothing but a number follows
_NAME = f"(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z]{{2}})(?=PASS|PWD|SECRET|TOKEN)){_CREDENTIAL}(?:[_-]?[0-9]{{1,2}})?"
_USERINFO = "://[^\\s/:@\"'<>]{0,64}:$"
_HOLDER = "(?i)(?:your|example|sample|change[_-]?me|insert|placeholder|dummy|here$|^\\W*$|^(.)\\1+$|x{4}|\\$|%|null|none|true|false|undefined)"
FORMATS = ("(?:AKIA|ASIA)[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,255}", "github_pat_[A-Za-z0-9_]{22,255}",
           "glpat-[A-Za-z0-9_-]{20,64}", "xox[abeoprs]-[A-Za-z0-9-]{10,255}", "AIza[A-Za-z0-9_-]{35}",
           "[sr]k_(?:live|test)_[A-Za-z0-9]{16,255}", "sk-[A-Za-z0-9_-]{32,255}", "npm_[A-Za-z0-9]{36}",
           "hf_[A-Za-z0-9]{30,64}", "SG\\.[A-Za-z0-9_-]{16,64}\\.[A-Za-z0-9_-]{16,64}",
           "eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+(?:\\.[A-Za-z0-9_-]++)?")
_FORMAT = "(?:" + "|".join(FORMATS) + ")(?![A-Za-z0-9_-])"
_SEPARATOR = "[\"']?[ \\t]{0,4}(?::=|=>|[:=])[ \\t]{0,4}"
# the short look back comes first: the long one is tried only after a separator
_INTRODUCED = (f"(?<=[:=>][ \\t]{{0,4}}[\"'`]?)(?<={_NAME}{_SEPARATOR}[\"'`]?)(?!(?i:bearer|basic)[ \\t])"
               "(?:(?<=[\"'`])[^\\s\"'`]{4,}+(?=[\"'`])|(?![^\\s\"'`<>,;&(){}\\[\\]|]++[(\\[])"
               "[^\\s\"'`<>,;&(){}\\[\\]|=:>][^\\s\"'`<>,;&(){}\\[\\]|]{2,}[^\\s\"'`<>,;&(){}\\[\\]|.:?])")
_BEARER = ("(?<=[ \\t])(?<=(?i:bearer|(?<![A-Za-z0-9])basic)[ \\t]{1,4})"
           "(?=[a-z]*+[A-Z0-9._~+/=-])[A-Za-z0-9_~+/-][A-Za-z0-9._~+/-]{6,}[A-Za-z0-9_~+/-]={0,2}")
_PASSWORD = "(?<=:)(?<=://[^\\s/:@\"'<>]{0,64}:)[^\\s/@\"'<>]++(?=@)"
_RUN = (f"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?![A-Za-z0-9_-]{{0,40}}{_NAME}{_SEPARATOR}[\"'`]?[^\\s\"'`=])"
        "[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
CANDIDATE = f"{_INTRODUCED}|{_BEARER}|{_PASSWORD}|(?<![A-Za-z0-9+/_-]){_FORMAT}|{_RUN}"
# every text with a candidate passes
_HELD = ("[0-9]|://|(?i:token|key|secret|passw|pwd|passphrase|auth|credential|bearer|basic)|"
         "(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox|AIza|[sr]k[_-]|npm_|hf_|SG\\.|eyJ)")
FEATURES = ("length", "digit_share", "upper_share", "letter_digit_turns", "case_turns", "distinct_share",
            "dictionary_share", "slashes", "path_before", "quoted", "assigned", "credential_name",
            "harmless_word", "hex_only", "digits_only", "known_format", "userinfo", "letters_only", "blank_before",
            "placeholder", "word_signs", "dotted", "bearer", "date", "symbols", "closed")


def _formed(v: Column) -> Column:
    return F.rlike(v, F.lit(f"^{_FORMAT}$"))


def _gone(v: Column, pattern: str) -> Column:
    """How many characters of ``v`` the pattern takes."""
    return F.length(v) - F.length(F.regexp_replace(v, pattern, ""))


def _features(c: Column, words: list[str]) -> list[Column]:
    v, left, right = c["value"], c["left"], c["right"]
    n = F.length(v).cast("double")
    runs = F.regexp_extract_all(F.lower(v), F.lit("[a-z]{3,}"), F.lit(0))
    covered = F.aggregate(F.filter(runs, lambda w: w.isin(words)) if words else F.array().cast("array<string>"),
                          F.lit(0), lambda a, w: a + F.length(w))
    def is_(x: Column, pattern: str) -> Column:
        return F.rlike(x, F.lit(pattern)).cast("double")
    return [n, _gone(v, "[0-9]") / n, _gone(v, "[A-Z]") / n,
            F.regexp_count(v, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / n,
            F.regexp_count(v, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / n,
            F.size(F.array_distinct(F.split(v, ""))) / n, covered / n,
            _gone(v, "/").cast("double"), is_(left, "(?:/|\\\\|://[^\\s]*)$"),
            (F.rlike(left, F.lit("[\"'`]$")) & F.rlike(right, F.lit("^[\"'`]"))).cast("double"),
            is_(left, "[:=]\\s*[\"']?$"), is_(left, f"{_NAME}{_SEPARATOR}[\"'`]?$"),
            is_(F.right(left, F.lit(24)), _HARMLESS), is_(v, "^[0-9A-Fa-f]+$"), is_(v, "^[0-9]+$"), _formed(v).cast("double"),
            (F.rlike(left, F.lit(_USERINFO)) & F.rlike(right, F.lit("^@"))).cast("double"), is_(v, "^[A-Za-z]+$"),
            is_(left, "\\s$"), is_(v, _HOLDER), _gone(v, "[_-]").cast("double"), _gone(v, "[.]").cast("double"),
            is_(left, "(?i)(?:bearer|(?<![A-Za-z0-9])basic)\\s+$"), is_(v, "^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{8}T"),
            _gone(v, "[^A-Za-z0-9._/+=-]").cast("double"), is_(right, "^(?:[\"'`&,;\\n)}@]|$)")]


def with_candidates(docs: DataFrame, text_col: str, name: str = "__c") -> DataFrame:
    """Add ``name``: array<struct<start, end, value, left, right>>, the candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return with_matches(docs, name, text, CANDIDATE, F.rlike(text, F.lit(_HELD)), before=80,
                        searched_once=True)


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 2000) -> list[str]:
    """The ``size`` words (three letters or more) most frequent over all documents; ties by word."""
    words = docs.select(F.explode_outer(F.split(F.lower(text_col), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size)
    return sorted(r["w"] for r in top.collect())  # at most ``size`` words


def labelled(spark: SparkSession) -> DataFrame:
    """The findings of ``secret_examples`` (value, left, right, label, example)."""
    return spark.createDataFrame(secret_examples.rows(), "value string, left string, right string, label int, example int")


def _tree(node, f: list[Column]) -> Column:
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return (F.when(f[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), f))
            .otherwise(_tree(node.rightChild(), f)))


def train(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", trees: int = 25, depth: int = 9,
          words: list[str] | None = None, threshold: float = 0.5) -> dict:
    """Forest over labelled findings (value, left, right, label 0/1); ``docs`` give the dictionary."""
    words = sorted({*dictionary(docs, text_col), *secret_examples.WORDS}) if words is None else words
    rows = labelled(docs.sparkSession) if findings is None else findings
    rows = rows.where(F.col("label").isin(0, 1) & F.col("value").isNotNull())
    rows = rows.select(F.struct("value", F.coalesce("left", F.lit("")).alias("left"),
                                F.coalesce("right", F.lit("")).alias("right")).alias("c"), "label")
    cols = [x.alias(n) for n, x in zip(FEATURES, _features(F.col("c"), words), strict=True)]
    rows = rows.select(F.col("label").cast("double").alias("label"), *cols)
    model = {"words": words, "threshold": threshold, "forest": None, "prior": 0.0}
    rows = rows.cache()
    try:
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:
            model["prior"] = max(counts, default=0.0)
            return model
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        model["forest"] = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8,
                                                 featureSubsetStrategy="0.5").fit(data)
    finally:
        rows.unpersist()
    return model


def _votes(forest, prior: float, f: list[Column]) -> Column:
    """The share of the trees' votes for a secret."""
    if forest is None:
        return F.lit(float(prior))
    total = F.lit(0.0)
    for t in forest.trees:
        total = total + _tree(t._java_obj.rootNode(), f)
    return total / F.lit(float(forest.getNumTrees))


def judge(findings: DataFrame, model: dict) -> DataFrame:
    """``findings`` (value, left, right) with ``score``, for labelled findings apart from any text."""
    f = _features(F.struct("value", "left", "right"), model["words"])
    named = findings.select("*", *[x.alias(f"__{n}") for n, x in zip(FEATURES, f, strict=True)])
    return named.withColumn("score", _votes(model["forest"], model["prior"], [F.col(f"__{n}") for n in FEATURES])) \
        .drop(*[f"__{n}" for n in FEATURES])


def scan(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``findings``: array of (start, end, value, score, secret) over all candidates,
    offsets in code points."""
    with_features = F.transform(F.col("__c"), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
        *[x.alias(n) for n, x in zip(FEATURES, _features(c, model["words"]), strict=True)]))
    judged = F.transform(F.col("__f"), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
        _votes(model["forest"], model["prior"], [c[n] for n in FEATURES]).alias("score")))
    final = F.transform(F.col("__s"), lambda c: F.struct(
        c["start"], c["end"], c["value"], c["score"], (c["score"] >= model["threshold"]).alias("secret")))
    return (with_candidates(docs, text_col)
            .withColumn("__f", with_features).withColumn("__s", judged)
            .withColumn("findings", final).drop("__c", "__f", "__s"))


def redact(docs: DataFrame, model: dict, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``."""
    text = F.col(text_col)
    scanned = scan(docs.drop("findings"), model, text_col)
    bad = F.filter(F.col("findings"), lambda c: c["secret"])
    # the text between the secrets, cut at their offsets
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(bad, lambda c: c["end"]))
    ends = F.concat(F.transform(bad, lambda c: c["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(edges, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return (scanned.withColumn(text_col, F.when(F.size(bad) > 0, F.array_join(pieces, mark)).otherwise(text))
            .select(*docs.columns))
