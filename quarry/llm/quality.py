"""Quality classifier: Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a label-1 text is preferred to a label-0 text).
Weights of a linear score are learned by logistic loss on feature differences, that is
P(i preferred to j) = sigmoid(w . (x_i - x_j)).  The acceptance threshold is a quantile of
the latent scores of the training rows (by default the share of label 0), and the published
score is the logistic of the distance to that quantile, placed so that ``threshold`` is the
published score at the quantile.

Scale: fitting takes every labelled row and every pair of a label-1 and a label-0 row.  Texts become
features once, in the tasks that read them; these meet the labels and are written.  A pair's loss depends
on two scores alone, so a Newton step deals each row out to the two places of a grid next to its score
(``GRID`` places a unit, the loss linear between them) and sums the rows of a place: two aggregates over
the features, whose results have a row a place.  The quantile is the exact order statistic of all rows.
Scoring is one narrow pass, no shuffle.

Defined results: null or empty text has all features at their empty value (0) and gets a
score like any other row; null ids are scored (``held_out`` is null for them in the query);
labels with a null class, or without a document, are ignored; repeated documents get equal
scores; repeated labels count as often as they occur; without labels of both classes every
score is 0.5; an empty table gives an empty result; other columns pass through unchanged
(``score`` and ``predicted`` overwrite columns of those names).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import _text as X
from quarry.llm._io import written

FEATURES = ("log_bytes", "upper", "digit", "symbol", "newline", "space", "word_length", "symbol_end",
            "symbol_only", "same_as_previous", "repeated_words", "repeated_grams", "long_words",
            "sentence_ends")
_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_STOP = np.isin(_CODES, list(b".,;:?'\"()-"))
_SYMBOL = ~X.WORD & ~X.SPACE & ~_STOP
_TOKEN = ~X.SPACE


def _distinct_per_text(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if len(key) == 0:
        return np.zeros(n, np.int64)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def features(col: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    out = np.zeros((len(col), len(FEATURES)))
    for i, j, data, off in X.chunks(col):
        n = j - i
        size = np.maximum(np.diff(off), 1)
        s, e, w_off = X.word_spans(data, off, _TOKEN)
        words = np.diff(w_off)
        at_least = np.maximum(words, 1)
        doc = np.repeat(np.arange(n), words)
        low = X.LOWER[data]
        h = X.span_hash(low, s, e)
        symbol = _SYMBOL[data]
        f = out[i:j]
        f[:, 0] = np.log1p(np.diff(off)) / 10
        for k, table in ((1, _UPPER), (2, _DIGIT), (3, _SYMBOL), (4, _CODES == 10), (5, _CODES == 32)):
            f[:, k] = X.segment_sum(table[data], off) / size
        f[:, 6] = X.segment_sum(e - s, w_off) / at_least / 10
        if len(s):
            last = symbol[e - 1]
            f[:, 7] = X.segment_sum(last, w_off) / at_least
            f[:, 8] = X.segment_sum((e - s == 1) & last, w_off) / at_least
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            f[:, 9] = X.segment_sum(same, w_off) / at_least
            f[:, 10] = 1 - _distinct_per_text(doc, h, n) / at_least
            grams = X.gram_hash(h, 3)
            inside = doc[2:] == doc[:-2]
            f[:, 11] = 1 - (_distinct_per_text(doc[2:][inside], grams[inside], n)
                            / np.maximum(words - 2, 1))
            f[words < 3, 11] = 0
            f[words == 0, 10] = 0
            f[:, 12] = X.segment_sum(e - s > 20, w_off) / at_least
            f[:, 13] = X.segment_sum(_STOP[data[e - 1]], w_off) / at_least
    return out


def _feature_column(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(col: pa.Array) -> pa.Array:
        x = features(col)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32),
                                        pa.array(x.ravel()))
    return of(text)


GRID = 16  # places a unit of score
DIGITS = 6  # of the model: sums that Spark adds up in another order give the same one
BUCKETS = 4096  # counted at a time to find an order statistic


def _standard(mean: np.ndarray, scale: np.ndarray) -> list[Column]:
    return [(F.col("x")[i] - F.lit(float(m))) / F.lit(float(s)) for i, (m, s) in enumerate(zip(mean, scale, strict=True))]


def _latent(z: list[Column], w: np.ndarray) -> Column:
    return sum((c * F.lit(float(v)) for c, v in zip(z, w, strict=True)), F.lit(0.0))


def _places(rows: DataFrame, z: list[Column], w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per label: the places of the grid that rows are next to, the rows dealt to each, and the sums of their
    features.  A row a place comes back, whatever the number of rows."""
    at = rows.select("y", *[c.alias(f"z{i}") for i, c in enumerate(z)], (_latent(z, w) * GRID).alias("s"))
    low = F.floor("s")
    near = at.withColumn("p", F.explode(F.array(
        F.struct(low.alias("at"), (1 - (F.col("s") - low)).alias("share")),
        F.struct((low + 1).alias("at"), (F.col("s") - low).alias("share")))))
    sums = near.groupBy("y", F.col("p.at").alias("at")).agg(
        F.sum("p.share").alias("n"), *[F.sum(F.col("p.share") * F.col(f"z{i}")).alias(f"z{i}") for i in range(len(z))])
    found = np.array(sorted(tuple(r) for r in sums.collect()))
    return [(t[:, 1] / GRID, t[:, 2], t[:, 3:]) for t in (found[found[:, 0] == label] for label in (0, 1))]


def _curvature(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, weights) -> np.ndarray:
    """Sum of z z' over the rows, each weighted by its label's weights (places, values) at its score."""
    def run(batches):
        total = np.zeros((len(w), len(w)))
        for batch in batches:
            z = (np.asarray(batch.column(1).flatten()).reshape(-1, len(w)) - mean) / scale
            y, s = np.asarray(batch.column(0)), z @ w
            c = np.where(y == 1, np.interp(s, *weights[1]), np.interp(s, *weights[0]))
            total += (z * c[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])
    sums = rows.select("y", "x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    return np.array([v for _, v in sorted(tuple(r) for r in sums.collect())]).reshape(len(w), len(w))


def fit_bradley_terry(rows: DataFrame, l2: float = 1e-3, steps: int = 60) -> dict:
    """Newton iterations on the pairwise logistic loss over all pairs of rows (y, x) of different
    classes; one class only: no model."""
    k = len(FEATURES)
    of = rows.agg(F.count_if(F.col("y") == 0).alias("down"), F.count_if(F.col("y") == 1).alias("up"),
                  *[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)]).first()
    if not of["up"] or not of["down"]:
        return {"w": None}
    mean, scale = np.round(of[2:2 + k], 12), np.array(of[2 + k:])
    scale = np.where(scale < 1e-9, 1.0, np.round(scale, 12))
    z, w, pairs = _standard(mean, scale), np.zeros(k), float(of["up"]) * of["down"]
    for _ in range(steps):
        (t0, n0, z0), (t1, n1, z1) = _places(rows, z, w)
        grad, cross, c0, c1 = np.zeros(k), np.zeros((k, k)), np.zeros(len(t0)), np.zeros(len(t1))
        for i in range(0, len(t1), 256):
            part = slice(i, i + 256)
            q = 1 / (1 + np.exp(np.clip(t1[part, None] - t0, -30, 30)))
            v = q * (1 - q)
            grad += (q @ n0) @ z1[part] - (n1[part] @ q) @ z0
            cross += z1[part].T @ (v @ z0)
            c1[part], c0 = v @ n0, c0 + n1[part] @ v
        hess = (_curvature(rows, mean, scale, w, ((t0, c0), (t1, c1))) - cross - cross.T) / pairs + l2 * np.eye(k)
        step = np.linalg.solve(hess, grad / pairs - l2 * w)
        w = w + step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return {"w": np.round(w, DIGITS), "mean": mean, "scale": scale}


def _around(values: DataFrame, k: int) -> tuple[float, float]:
    """The k-th smallest (from 1) of a table's numbers ``s`` and the one after it (itself if last): buckets
    are counted, then the buckets of the one that holds it, until it holds one value only."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    below, after = 0, None
    while True:
        width = (high - low) / BUCKETS
        bucket = F.least(F.floor((F.col("s") - low) / width), F.lit(BUCKETS - 1)) if width > 0 else F.lit(0)
        found = sorted(tuple(r) for r in values.where(F.col("s").between(low, high)).groupBy(bucket.cast("long").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("s"), F.max("s")).collect())  # at most BUCKETS rows
        at = 0
        while below + found[at][1] < k:
            below, at = below + found[at][1], at + 1
        after = found[at + 1][2] if at + 1 < len(found) else after
        _, n, low, high = found[at]
        if low == high:
            return low, low if below + n > k or after is None else after


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", threshold: float = 0.3, quantile: float | None = None) -> dict:
    """Fit on all labelled rows.  ``quantile`` of their latent scores is the acceptance threshold; None:
    the share of label 0."""
    marked = (labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y"))
              .where(F.col("y").isin(0, 1) & F.col("__id").isNotNull()))
    # features are made before the join: no text is shuffled
    rows = written(docs.where(F.col(id_col).isNotNull())
                   .select(F.col(id_col).alias("__id"), _feature_column(F.col(text_col)).alias("x"))
                   .join(marked, "__id").select("y", "x"), "quality-features")
    model = fit_bradley_terry(rows)
    if model["w"] is not None:
        values = rows.select("y", _latent(_standard(model["mean"], model["scale"]), model["w"]).alias("s"))
        n, down, spread = values.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 0), F.stddev_pop("s")).first()
        q = down / n if quantile is None else quantile
        model["cut"] = round(sum(_around(values, min(n - 1, max(1, int(round(q * n)))))) / 2, 2 * DIGITS)
        model["spread"] = round(max(1e-6, spread), DIGITS)
    model["threshold"] = threshold
    return model


def _score_column(model: dict, text: Column) -> Column:
    if model["w"] is None:
        return F.lit(0.5)
    shift = float(np.log(model["threshold"] / (1 - model["threshold"])))

    @F.arrow_udf(T.DoubleType())
    def published(col: pa.Array) -> pa.Array:
        z = (features(col) - model["mean"]) / model["scale"]
        d = 4 * (z @ model["w"] - model["cut"]) / model["spread"] + shift
        return pa.array(1 / (1 + np.exp(-np.clip(d, -500, 500))))
    return published(text)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1: score >= threshold)."""
    return (docs.withColumn("score", _score_column(model, F.col(text_col)))
            .withColumn("predicted", (F.col("score") >= F.lit(model["threshold"])).cast("int")))


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold."""
    return docs.where(_score_column(model, F.col(text_col)) >= F.lit(model["threshold"]))
