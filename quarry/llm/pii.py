"""Personal data by weak supervision, in built-in functions only.

Candidates of four kinds (email, ip, card, phone) come from the base patterns and from looser
ones (spelled-out addresses, local phone numbers, numbers that fail a check).  Labelers vote on
each (1 for, -1 against, 0 abstains): the strict pattern, a check of the value (Luhn, octets,
digit counts, top-level domain), a gazetteer (issuer and country prefixes, well-known domains,
special networks), the words before it, and its borders.  Vote patterns are counted over all
documents (a few hundred rows at most, whatever the input); expectation-maximisation on the
counts estimates how reliable each labeler is for each kind and the probability of each
pattern, and these train the final span classifier, a logistic regression on votes and kind
whose weights become a column expression.

Base spans always stay; others are kept where the classifier gives ``threshold`` or more and
they do not overlap a base span of their kind.

Defined results: null or empty text has no spans; null ids are ordinary values; repeated
documents give equal results (and count in the statistics); an empty table, or one without
candidates, gives documents with base spans only; results replace input columns of the same
names (``spans``), others pass through.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._io import written
from quarry.llm._spans import with_matches

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Possessive repeats and the guards in front change no match (the classes on
# both sides of each repeat are disjoint, \G lets a match begin where the last one ended); they
# keep long runs linear and off the matcher's stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# looser candidates
SPELLED = (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|(?<= )at(?= )|@) ?"
           r"[a-z0-9-]{1,63}+ ?(?:\[dot\]|\(dot\)|(?<= )dot(?= )) ?[a-z]{2,24}+(?![a-z0-9])")
LOCAL = r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
# gazetteers and context words
_TLD = r"(?i)\.(?:com|org|net|edu|gov|io|co|de|fr|es|uk|eu|us|info|example)$"
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_SPECIAL_NET = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_FOR = {"email": r"(?i)(?:e-?mail|mailto|contact|write|reach|from|@)\W*$",
        "ip": r"(?i)(?:\bip\b|addr|address|host|server|from|client|login)\W*\w*\W*$",
        "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|cc)\W*\w*\W*$",
        "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|dial)\W*\w*\W*$"}
_AGAINST = r"(?i)(?:version|isbn|order|serial|invoice|ref|section|no\.|#|v)\W*$"
VOTES = ("strict", "valid", "gazetteer", "context", "border")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i:
                    F.when(i % 2 == 0, c.cast("int")).otherwise(
                        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, "\\."), lambda p: F.rlike(
        p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.otherwise(0) if no is None else out.when(no, -1).otherwise(0)).cast("int")


def _candidate(kind: str, c: Column, base: Column, loose: bool) -> Column:
    v, left, right = c["value"], c["left"], c["right"]
    n = F.length(_digits(v))
    if kind == "email":
        valid, known = _vote(F.rlike(v, F.lit("[A-Za-z]$")), F.rlike(v, F.lit("[0-9-]$"))), _vote(F.rlike(v, F.lit(_TLD)))
        inside = F.rlike(right, F.lit("^[@A-Za-z0-9]"))
    elif kind == "ip":
        valid, known = _vote(_octets(v), ~_octets(v)), _vote(F.lit(False), F.rlike(v, F.lit(_SPECIAL_NET)))
        inside = F.rlike(left, F.lit(r"[0-9A-Za-z]\.?$")) | F.rlike(right, F.lit(r"^\.?[0-9A-Za-z]"))
    elif kind == "card":
        valid = _vote(n.between(13, 19) & luhn(_digits(v)), ~luhn(_digits(v)))
        known = _vote(F.rlike(_digits(v), F.lit(_ISSUER)), ~F.rlike(_digits(v), F.lit(_ISSUER)))
        inside = F.rlike(left, F.lit("[0-9A-Za-z.+]$")) | F.rlike(right, F.lit("^[.]?[0-9A-Za-z]"))
    else:
        valid = _vote(n.between(10, 13), ~n.between(8, 15))
        known = _vote(F.rlike(v, F.lit(_COUNTRY)), F.rlike(v, F.lit(r"^\+0")))
        inside = F.rlike(left, F.lit("[0-9A-Za-z]$")) | F.rlike(right, F.lit("^[0-9A-Za-z]"))
    context = _vote(F.rlike(left, F.lit(_FOR[kind])), F.rlike(left, F.lit(_AGAINST)))
    strict = F.lit(-1) if loose else _vote(base, ~base)
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                    base.alias("base"), strict.cast("int").alias("strict"), valid.alias("valid"),
                    known.alias("gazetteer"), context.alias("context"), _vote(~inside, inside).alias("border"))


def _is_base(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    return {"email": F.lit(True), "ip": _octets(v), "card": n.between(16, 19) & luhn(_digits(v)),
            "phone": n.between(8, 15)}[kind]


def with_candidates(docs: DataFrame, text_col: str = "text", name: str = "__candidates") -> DataFrame:
    """Add ``name``: array of (kind, start, end, base, votes) in order of kind and start; candidates
    of the loose patterns that overlap a base span of their kind are left out."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    digit = F.rlike(t, F.lit("[0-9]"))
    df = with_matches(docs, "__email", t, EMAIL, F.contains(t, F.lit("@")))
    df = with_matches(df, "__ip", t, IP, digit)
    df = with_matches(df, "__card", t, CARD, digit)
    df = with_matches(df, "__phone", t, PHONE, F.contains(t, F.lit("+")))
    df = with_matches(df, "__spelled", t, SPELLED, F.rlike(t, F.lit(r"(?i)(?:\[dot\]|\(dot\)| dot )")))
    df = with_matches(df, "__local", t, LOCAL, digit)
    # runs of digits with other than 13 to 19 digits are no candidates for cards
    df = df.withColumn("__card", F.filter("__card", lambda c: F.length(_digits(c["value"])).between(13, 19)))
    for kind in KINDS:
        df = df.withColumn(f"__{kind}", F.transform(f"__{kind}", _strict(kind)))
    for kind, loose in (("email", "__spelled"), ("phone", "__local")):
        base = F.filter(f"__{kind}", lambda c: c["base"])
        df = df.withColumn(loose, F.transform(F.filter(loose, _apart_from(base)), _loose(kind)))
    found = F.concat(F.array_sort(F.concat("__email", "__spelled"), _by_start), F.col("__ip"), F.col("__card"),
                     F.array_sort(F.concat("__phone", "__local"), _by_start))
    return df.withColumn(name, found).drop("__email", "__ip", "__card", "__phone", "__spelled", "__local")


def _strict(kind: str):
    return lambda c: _candidate(kind, c, _is_base(kind, c["value"]), False)


def _loose(kind: str):
    return lambda c: _candidate(kind, c, F.lit(False), True)


def _apart_from(spans: Column):
    return lambda c: ~F.exists(spans, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))


def _by_start(a: Column, b: Column) -> Column:
    return (a["start"] - b["start"]).cast("int")


def estimate(patterns: list[tuple[tuple[int, tuple[int, ...]], int]], rounds: int = 100) -> dict:
    """Expectation-maximisation over counted vote patterns: {pattern: probability of a true span}.
    Each kind has its own prior and each labeler its own vote distribution per truth value."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(p[1], n) for p, n in patterns if p[0] == kind]
        if not rows:
            continue
        # the start is the majority of the votes
        prob = [1 / (1 + math.exp(-sum(v))) for v, _ in rows]
        for _ in range(rounds):
            weight = sum(n for _, n in rows)
            prior = (sum(n * p for (_, n), p in zip(rows, prob, strict=True)) + 1) / (weight + 2)
            like: list[dict] = []
            for j in range(len(VOTES)):
                table = {}
                for truth in (0, 1):
                    mass = {-1: 0.5, 0: 0.5, 1: 0.5}
                    # a labeler is at least weakly right: one pseudo-vote for the truth
                    mass[1 if truth else -1] += 1.0
                    for (v, n), p in zip(rows, prob, strict=True):
                        mass[v[j]] += n * (p if truth else 1 - p)
                    total = sum(mass.values())
                    table[truth] = {x: m / total for x, m in mass.items()}
                like.append(table)
            new = []
            for v, _ in rows:
                a = math.log(prior) + sum(math.log(like[j][1][x]) for j, x in enumerate(v))
                b = math.log(1 - prior) + sum(math.log(like[j][0][x]) for j, x in enumerate(v))
                new.append(1 / (1 + math.exp(max(-500.0, min(500.0, b - a)))))
            moved = max(abs(x - y) for x, y in zip(new, prob, strict=True))
            prob = new
            if moved < 1e-6:
                break
        out.update({(kind, v): p for (v, _), p in zip(rows, prob, strict=True)})
    return out


def _inputs(kind: int, votes: tuple[int, ...]) -> list[float]:
    """Per kind: an intercept and each vote's for and against."""
    x = [0.0] * (len(KINDS) * (1 + 2 * len(VOTES)))
    at = kind * (1 + 2 * len(VOTES))
    x[at] = 1.0
    for j, v in enumerate(votes):
        if v:
            x[at + 1 + 2 * j + (v < 0)] = 1.0
    return x


def train(candidates: DataFrame, name: str = "__candidates") -> list[float] | None:
    """Weights of the final classifier; None without candidates."""
    spark = candidates.sparkSession
    # explode_outer: a plain explode would make the optimizer repeat the search in a filter
    counted = (candidates.select(F.explode_outer(name).alias("c")).where("c.kind is not null")
               .groupBy("c.kind", *[f"c.{v}" for v in VOTES]).count().collect())  # at most 4 * 3^5 rows
    if not counted:
        return None
    counts = [((r["kind"], tuple(r[v] for v in VOTES)), r["count"]) for r in counted]
    truth = estimate(counts)
    total = sum(n for _, n in counts)
    rows = []
    for p, n in sorted(counts):
        x = Vectors.dense(_inputs(*p))
        rows += [(1.0, truth[p] * n / total, x), (0.0, (1 - truth[p]) * n / total, x)]
    data = spark.createDataFrame(rows, ["label", "weight", "features"])
    fit = LogisticRegression(weightCol="weight", regParam=1e-5, standardization=False, fitIntercept=False,
                             maxIter=100).fit(data)
    return [float(w) for w in fit.coefficients]


def _probability(c: Column, weights: list[float]) -> Column:
    per = 1 + 2 * len(VOTES)

    def of(kind: int) -> Column:
        w = weights[kind * per:(kind + 1) * per]
        terms = [F.when(c[v] > 0, w[1 + 2 * j]).when(c[v] < 0, w[2 + 2 * j]).otherwise(0.0)
                 for j, v in enumerate(VOTES)]
        return reduce(lambda a, b: a + b, terms, F.lit(w[0]))
    z = reduce(lambda acc, k: acc.when(c["kind"] == k, of(k)), range(1, len(KINDS)), F.when(c["kind"] == 0, of(0)))
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the text, with ``spans``: array of (kind, start, end, base, probability)."""
    rest = [c for c in docs.columns if c not in (text_col, "spans", "__candidates")]
    found = written(with_candidates(docs, text_col).select(*rest, "__candidates"), "pii-candidates")
    weights = train(found)
    names = F.array(*[F.lit(k) for k in KINDS])
    probability = (lambda c: F.lit(1.0)) if weights is None else (lambda c: _probability(c, weights))
    spans = F.transform("__candidates", lambda c: F.struct(
        F.get(names, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        c["base"].alias("base"), probability(c).alias("probability")))
    return (found.withColumn("spans", spans)
            .withColumn("spans", F.filter("spans", lambda c: c["base"] | (c["probability"] >= threshold)))
            .drop("__candidates"))
