"""Toxicity: a linear-chain conditional random field tags toxic words.

Labelled tokens come from labelled documents: words that occur in toxic texts far beyond chance,
and beginnings of words that several different words of a text share far beyond chance
(likelihood ratio against the base rate, counted over texts that are not near copies: word sets
that MinHash bands bring together and whose exact Jaccard is at least ``NEAR``), are
tagged in toxic texts, every other token is clean.  The field has word, beginning, capital and
length features and a transition matrix, trained by maximum likelihood (forward-backward
gradients) on chains of ``CHAIN`` words.  Scoring runs forward-backward over every chain of every
whole text; marginals of at least ``floor`` form spans, and a logistic function of the highest
marginal, the expected number of toxic tokens and their density, fitted on the same labelled
texts, gives the document's score.

Scale: fitting reads a bounded sample (``max_train`` labelled texts, lowest id hashes); scoring
is one narrow pass over all texts, no shuffle.

Defined results: null or empty text has no spans; null ids are ordinary values;
labels with a null class, or without a document, are ignored; repeated documents get equal
scores and repeated labels count as often as they occur; without toxic and clean labels, or
without words that stand out, every score is 0; null and empty texts score like any text without spans; an empty table gives an empty result; other
columns pass through (``score``, ``predicted`` and ``spans`` replace columns of those names).
Offsets are code points, ends exclusive; spans follow the text's order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _text as X
from quarry.llm.paragraphs import _jaccard, _signatures, tune

CHAIN = 32
NEAR = 0.8
SHAPES = 4  # bias, all capitals, short, long
BEGINNINGS = (5, 7)
_CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def _tokens(data: np.ndarray, off: np.ndarray):
    """(feature hashes, starts, ends, offsets per text, shape flags) of the words of some texts.
    Features: the word, and its first 5 and 7 bytes if it is longer (0: none)."""
    low = X.lower_bytes(data)
    s, e, w_off = X.word_spans(low, off)
    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    shape = np.ones((len(s), SHAPES), bool)
    shape[:, 1] = (capitals[e] - capitals[s] == e - s) & (e - s > 1)
    shape[:, 2], shape[:, 3] = e - s <= 3, e - s >= 10
    h = np.zeros((len(s), 1 + len(BEGINNINGS)), np.uint64)
    pre = X.prefix_hash(low)
    h[:, 0] = X.span_hash(low, s, e, pre)
    for j, k in enumerate(BEGINNINGS):
        more = e - s > k
        h[more, 1 + j] = X.span_hash(low, s[more], s[more] + k, pre) ^ np.uint64(k)
    return h, s, e, w_off, shape


def _known(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of hashes in the sorted ``words``; len(words) for those that are not there."""
    at = np.searchsorted(words, h)
    return np.where(np.append(words, np.uint64(0))[at] == h, at, len(words))


def _chains(w_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chain of each word, place in it): texts cut into chains of ``CHAIN`` words."""
    words = np.diff(w_off)
    place = np.arange(w_off[-1]) - np.repeat(w_off[:-1], words)
    per = -(-words // CHAIN)
    first = np.cumsum(per) - per
    return np.repeat(first, words) + place // CHAIN, place % CHAIN


def _sweep(score: np.ndarray, used: np.ndarray, trans: np.ndarray):
    """(forward odds, backward odds, own weights, transition weights) of some chains (rows): odds of
    the toxic tag against the clean one, so one number a place carries the recursion."""
    a = np.exp(trans)
    own = np.where(used, np.exp(np.clip(score, -30, 30)), 1.0).T.copy()
    length = len(own)
    fore, back = np.ones(own.shape), np.ones(own.shape)
    fore[0] = own[0]
    for t in range(1, length):
        r = fore[t - 1]
        fore[t] = own[t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
    for t in range(length - 2, -1, -1):
        q = own[t + 1] * back[t + 1]
        back[t] = np.where(used[:, t + 1], (a[1, 0] + a[1, 1] * q) / (a[0, 0] + a[0, 1] * q), 1.0)
    return fore, back, own, a


def marginals(score: np.ndarray, used: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every place by forward-backward.  ``score``: log-odds by a word's own features;
    ``used``: places that hold a word; ``trans[i, j]``: log-weight of tag j after tag i."""
    fore, back, _, _ = _sweep(score, used, trans)
    odds = (fore * back).T
    return odds / (1 + odds)


def expectations(score: np.ndarray, used: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of every place, expected number of each transition) for the gradient."""
    fore, back, own, a = _sweep(score, used, trans)
    pairs = np.zeros((2, 2))
    for t in range(len(own) - 1):
        live = used[:, t + 1]
        f, q = fore[t, live], (own[t + 1] * back[t + 1])[live]
        m = np.array([[np.full(len(f), a[0, 0]), a[0, 1] * q], [f * a[1, 0], f * a[1, 1] * q]])
        pairs += (m / m.sum(axis=(0, 1))).sum(axis=2)
    odds = (fore * back).T
    return odds / (1 + odds), pairs


def telling_words(word: np.ndarray, group: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Words that stand out in toxic texts.  One entry per text and distinct word: word hash, the
    text's group of near copies (counted once per word) and its label."""
    words, w = np.unique(word, return_inverse=True)
    # a group and label in one number, below that of the word: sorting counts each once a word
    kinds = 2 * (int(group.max()) + 1)
    seen = np.unique(w * kinds + 2 * group + toxic)
    pos = np.bincount(seen[seen % 2 == 1] // kinds, minlength=len(words)).astype(float)
    neg = np.bincount(seen[seen % 2 == 0] // kinds, minlength=len(words)).astype(float)
    base = np.clip((np.unique(2 * group + toxic) % 2).mean(), 1e-6, 1 - 1e-6)
    q = np.clip(pos / np.maximum(pos + neg, 1), 1e-9, 1 - 1e-9)
    ratio = pos * np.log(q / base) + neg * np.log((1 - q) / (1 - base))
    tried = max(2, int((pos + neg >= 5).sum()))
    return words[(q >= 0.8) & (ratio >= np.log(tried) + 2)]


def near_copies(sets: list[np.ndarray], threshold: float = NEAR) -> np.ndarray:
    """A group per text, from the sorted distinct word hashes of each: a text joins the first text of
    a group that it shares a MinHash band with if their Jaccard is at least the threshold."""
    bands, rows = tune(threshold)
    group, first = np.zeros(len(sets), np.int64), {}
    for i, u in enumerate(sets):
        keys = list(enumerate(_signatures(u, np.array([0, len(u)]), bands, rows)[0].tolist())) if len(u) else [None]
        others = sorted({j for k in keys for j in first.get(k, ())})
        group[i] = next((j for j in others if not len(u) or _jaccard(u, sets[j], threshold)), i)
        if group[i] == i:
            for k in keys:
                first.setdefault(k, []).append(i)
    return group


def fit_field(texts: list[str], toxic: np.ndarray, chains: int = 6_000, rounds: int = 100, l2: float = 1e-4) -> dict:
    """Maximum likelihood on the chains with toxic tokens and an even sample of the others, at most
    ``chains`` in all, by Adam on the full gradient.  Texts are read a chunk at a time."""
    none = {"words": np.zeros(0, np.uint64)}
    order = sorted(range(len(texts)), key=lambda i: (xxhash.xxh64_intdigest(texts[i].encode("utf-8")), toxic[i]))
    col, y_doc = pa.array([texts[i] for i in order], pa.string()), toxic[order]
    if not len(order) or y_doc.min() == y_doc.max():
        return none
    word, near = [], []  # of each text: its words and shared beginnings, its words alone
    for i, _, data, off in X.chunks(col):
        h, _, _, w_off, _ = _tokens(data, off)
        for d in range(len(w_off) - 1):
            every = h[w_off[d]:w_off[d + 1]]
            own, first = np.unique(every[:, 0], return_index=True)
            # a beginning tells only where different words share it
            shared, times = np.unique(every[first, 1:], return_counts=True)
            word.append(np.concatenate([own, shared[(times >= 2) & (shared != 0)]]))
            near.append(own)
    size = np.array([len(u) for u in word])
    if not size.sum():
        return none
    _, group = np.unique(near_copies(near), return_inverse=True)
    lexicon = telling_words(np.concatenate(word), np.repeat(group, size), np.repeat(y_doc, size))
    del word, near

    def pick(wanted: int, tagged: bool, every: int = 1):
        """Chains with (or without) a toxic token: hashes, shapes, tags, chain, place."""
        out, taken, seen = [], 0, 0
        for i, _, data, off in X.chunks(col):
            h, _, _, w_off, shape = _tokens(data, off)
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(w_off) - 1), np.diff(w_off))
            tag = np.isin(h, lexicon).any(axis=1) & (y_doc[i + doc] == 1)
            chain, place = _chains(w_off)
            has = np.zeros(int(chain[-1]) + 1, bool)
            has[chain[tag]] = True
            some = np.flatnonzero(has == tagged)
            some, seen = some[(np.arange(len(some)) + seen) % every == 0][:wanted - taken], seen + len(some)
            number = np.full(len(has), -1)
            number[some] = taken + np.arange(len(some))
            taken += len(some)
            use = number[chain] >= 0
            out.append((h[use], shape[use], tag[use], number[chain[use]], place[use]))
        return [np.concatenate(x) for x in zip(*out, strict=True)], taken, seen

    with_tag, n_tag, _ = pick(chains // 2, True)
    if not n_tag:
        return none
    _, _, others = pick(0, False)
    without, n_without, _ = pick(chains - n_tag, False, max(1, others // max(1, chains - n_tag)))
    without[3] = without[3] + n_tag
    h, shape, tag, row, place = (np.concatenate([x, y]) for x, y in zip(with_tag, without, strict=True))
    words, count = np.unique(h, return_counts=True)
    words = words[((count >= 2) | np.isin(words, lexicon)) & (words != 0)]
    at = _known(h, words)
    used = np.zeros((n_tag + n_without, CHAIN), bool)
    used[row, place] = True
    y = np.zeros(used.shape)
    y[row, place] = tag
    s = shape.astype(float)
    params = [np.zeros(len(words) + 1), np.array([-3.0, 0, 0, 0]), np.zeros((2, 2))]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    a, b, both = y[:, :-1], y[:, 1:], used[:, 1:]
    observed = np.array([[((1 - a) * (1 - b) * both).sum(), ((1 - a) * b * both).sum()],
                         [(a * (1 - b) * both).sum(), (a * b * both).sum()]])
    for step in range(1, rounds + 1):
        score = np.zeros(used.shape)
        score[row, place] = params[0][at].sum(axis=1) + s @ params[1]
        p, pairs = expectations(score, used, params[2])
        miss = (y - p)[row, place]
        word_grad = np.bincount(at.ravel(), weights=np.repeat(miss, at.shape[1]), minlength=len(words) + 1)
        word_grad[-1] = 0  # unknown features have no weight
        grads = [word_grad / len(used) - l2 * params[0], s.T @ miss / len(used) - l2 * params[1],
                 (observed - pairs) / len(used) - l2 * params[2]]
        for k, g in enumerate(grads):
            m, v = moment[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            params[k] = params[k] + 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weight = params[0][:-1]
    keep = np.abs(weight) > 0.05
    model = {"words": words[keep], "weight": weight[keep], "shape": params[1], "trans": params[2], "final": None}
    x = np.concatenate([_evidence(data, off, model, 0.05)[0] for _, _, data, off in X.chunks(col)])
    model["final"] = _logistic(x, y_doc)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights and intercept by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w)),
                               x.T @ (y - p) / len(x) - l2 * w)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          max_train: int = 6_000) -> dict:
    """Fit on at most ``max_train`` labelled texts (those of lowest id hash; toxic ones take a third
    of the room at most, clean ones the rest)."""
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
             .where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull()))

    def lowest(y: int, n: int) -> DataFrame:
        return known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    picked = lowest(1, max_train // 3).unionByName(lowest(0, max_train - max_train // 3))
    rows = (docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
            .where("__text is not null").join(F.broadcast(picked), "__id")  # at most max_train rows of two numbers
            .select("__y", "__text").limit(2 * max_train).collect())
    return fit_field([r["__text"] for r in rows], np.array([r["__y"] for r in rows], dtype=np.int64))


_RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("p", T.DoubleType())])))])


def _evidence(data: np.ndarray, off: np.ndarray, model: dict, floor: float):
    """(highest marginal, expected toxic tokens and density of each text; the spans as (text,
    start, end, highest marginal))."""
    n = len(off) - 1
    x = np.zeros((n, 3))
    none = np.zeros(0, np.int64)
    h, s, e, w_off, shape = _tokens(data, off)
    if not len(h):
        return x, (none, none, none, np.zeros(0))
    weight = np.append(model["weight"], 0.0)
    own = weight[_known(h, model["words"])].sum(axis=1) + shape @ model["shape"]
    chain, place = _chains(w_off)
    grid, used = np.zeros((int(chain[-1]) + 1, CHAIN)), np.zeros((int(chain[-1]) + 1, CHAIN), bool)
    grid[chain, place], used[chain, place] = own, True
    p = marginals(grid, used, model["trans"])[chain, place]
    hot = np.flatnonzero(p >= floor)
    if not len(hot):
        return x, (none, none, none, np.zeros(0))
    doc = np.searchsorted(w_off, hot, side="right") - 1
    new = np.ones(len(hot), bool)
    new[1:] = (hot[1:] != hot[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hot)) - 1
    top = np.maximum.reduceat(p[hot], first)
    mass = np.bincount(doc, weights=p[hot], minlength=n)
    np.maximum.at(x[:, 0], doc[first], top)
    x[:, 1] = np.log1p(mass)
    x[:, 2] = np.log1p(100 * mass / np.maximum(np.diff(w_off), 1))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[off[:-1]][doc[first]]
    return x, (doc[first], points[s[hot[first]]] - base, points[e[hot[last]]] - base, top)


def _judge(col: pa.Array, model: dict, floor: float) -> pa.Array:
    n = len(col)
    score, found = np.zeros(n), []
    if len(model["words"]):
        w = model["final"]
        for i, j, data, off in X.chunks(col):
            x, (doc, start, end, top) = _evidence(data, off, model, floor)
            score[i:j] = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
            found.append((doc + i, start, end, top))
    doc, start, end, top = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 4
    edges = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)),
                                        pa.array(top.astype(float))], names=["start", "end", "p"])
    return pa.StructArray.from_arrays([pa.array(score), pa.ListArray.from_arrays(pa.array(edges), spans)],
                                      names=["score", "spans"])


def score(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3, floor: float = 0.05) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``spans``: array of (start, end, p)."""
    @F.arrow_udf(_RESULT)
    def judge(col: pa.Array) -> pa.Array:
        return _judge(col, model, floor)
    return (docs.withColumn("__judged", judge(F.col(text_col).cast("string")))
            .withColumn("score", F.col("__judged.score")).withColumn("spans", F.col("__judged.spans"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__judged"))
